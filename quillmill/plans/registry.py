"""All registered queries outside the training-text subpackage."""

from quillmill.plans import details, prepared, reference  # noqa: F401 (details registers with reference)

FLAGSHIP = "hybrid_retrieval"
QUERIES = {**reference.QUERIES, **prepared.QUERIES}
ORACLE: dict[str, str] = dict(reference.ORACLE)
