"""quire: page text to searchable corpus, question retrieval and answer checks, as Spark DataFrame operators."""

__version__ = "0.1.0"
