"""quillmill.functions"""
