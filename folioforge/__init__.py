"""folioforge: document-corpus analytics on PySpark.

The core package holds the corpus operators (cleanup, segmentation, matching,
bibliography, notes, queues); ``folioforge.llm`` holds the operators that prepare
training text and may be removed without touching the core.
"""

__version__ = "0.1.0"
