import random

from quillmill.operators.multivalue import pieces, shape, split_values

GIVEN, FAMILY = ["Ana", "Bo", "Carla", "Dieter", "Eva", "Finn", "Gesa"], ["Holm", "Iversen", "Jansen", "Keller", "Lindt", "Maurer", "Nolde"]


def _person(r):
    return r.choice(GIVEN), r.choice(FAMILY)


def test_planted_fields_come_back(spark):
    r = random.Random(3)
    rows, want = [], {}
    styles = [("; ", "{g} {f}"), (" | ", "{g} {f}"), (", ", "{g} {f}"), ("; ", "{f}, {g}"), (" and ", "{f}, {g}"), ("\n", "{g} {f}"), (", ", '"{f}, {g}"'), (" & ", "{g} {f}")]
    for i in range(240):
        sep, form = styles[i % len(styles)]
        names = [form.format(g=g, f=f) for g, f in (_person(r) for _ in range(r.randint(2, 6)))]
        rows.append((i, sep.join(names)))
        want[i] = [n.strip('"') for n in names]
    group = "Institute of Wind and Rain"
    rows += [(500 + i, group) for i in range(12)] + [(600, f"Ana Holm, {group}"), (601, f'"{group}, North Branch"; Bo Lindt'), (602, f"{group} and Eva Nolde")]
    want |= {500 + i: [group] for i in range(12)} | {600: ["Ana Holm", group], 601: [f"{group}, North Branch", "Bo Lindt"], 602: [group, "Eva Nolde"]}
    df = spark.createDataFrame(rows, "id long, field string")
    got: dict = {}
    for x in split_values(df, "id", "field").collect():
        got.setdefault(x["id"], {})[x["pos"]] = x["value"]
    assert {k: [v[p] for p in sorted(v)] for k, v in got.items()} == want
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in got.values())


def test_edges(spark):
    rows = [
        (1, None), (2, ""), (3, "  "), (4, ";;, ;"), (5, "Ana Holm; et al."), (6, '"Ana ""Nan"" Holm", Bo Lindt'), (7, '["Ana Holm", "Bo \\"B\\" Lindt"]'),
        (8, "Ana Holm; Ana Holm"), (8, "Ana Holm; Ana Holm"), (9, "; Ana Holm; ; Bo Lindt;"), (10, "王芳、李明"), (11, "王芳　李明"), (12, "x" * 200_000), (13, '"unclosed; Ana Holm'),
    ]
    df = spark.createDataFrame([(a, b, "extra", 7) for a, b in rows], "id long, field string, value string, pos int")
    got: dict = {}
    for x in split_values(df, "id", "field").orderBy("id", "pos").collect():
        got.setdefault(x["id"], []).append(x["value"])
    assert got[5] == ["Ana Holm"] and got[6] == ['Ana "Nan" Holm', "Bo Lindt"] and got[7] == ["Ana Holm", 'Bo "B" Lindt']
    assert got[8] == ["Ana Holm", "Ana Holm"] and got[9] == ["Ana Holm", "Bo Lindt"]
    assert got[10] == got[11] == ["王芳", "李明"] and got[12] == ["x" * 200_000] and got[13][-1] == "Ana Holm"
    assert not {1, 2, 3, 4} & set(got)
    assert split_values(df.limit(0), "id", "field").count() == 0


def test_quoted_spans_are_atoms():
    assert [t for seg in pieces('"A; B", C D') for t, _, _ in seg] == ["A; B", "C D"]
    assert shape("de la Holm, Ana B.") == "ppW,WI" and shape("王芳") == "Z"


def test_no_bound_on_pieces(spark):
    """A long group name that is quoted once is known wherever it stands; long lists of people stay split."""
    group = "Institute of Heat, Light, Sound, Motion, and Matter"
    people = [f"{g} {f}" for g in GIVEN for f in FAMILY]
    rows = [(1, f'"{group}"; Ana Holm'), (2, f"Bo Lindt, {group}"), (3, group), (4, ", ".join(people)), (5, ", ".join(people * 20)), (6, "; ".join(people)), (7, f'"{group}"; Eva Nolde')]
    df = spark.createDataFrame(rows, "id long, field string")
    got: dict = {}
    for x in split_values(df, "id", "field").collect():
        got.setdefault(x["id"], {})[x["pos"]] = x["value"]
    got = {k: [v[p] for p in sorted(v)] for k, v in got.items()}
    assert got[1] == [group, "Ana Holm"] and got[2] == ["Bo Lindt", group] and got[3] == [group]
    assert got[4] == got[6] == people and got[5] == people * 20


def test_hot_field(spark):
    """Half of all rows hold one field; they cost one lattice and all come back."""
    df = spark.range(4000).selectExpr("id", "if(id % 2 = 0, 'Ana Holm, Bo Lindt and Eva Nolde', concat('Ana Holm, P', char(65 + id % 26), 'n Q', char(65 + id % 7), 'x')) as field")
    out = split_values(df, "id", "field")
    assert out.filter("id % 2 = 0").count() == 6000 and out.filter("id % 2 = 1").count() == 4000
