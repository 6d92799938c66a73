"""Training-data operators: ten corpus operators and the queries built on them.

Nothing outside this subpackage imports it; ``corpus_pipeline.py`` at the
repository top chains five of the operators.
"""
