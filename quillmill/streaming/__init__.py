"""quillmill.streaming"""
