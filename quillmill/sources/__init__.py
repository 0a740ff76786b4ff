"""quillmill.sources: files in, tables out, and the plug-ins that call services."""
