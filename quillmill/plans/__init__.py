"""quillmill.plans: the registered queries and their SQL counterparts."""
