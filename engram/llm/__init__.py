"""Training-data operators: one module per operator, `queries.py` registers them.

Nothing outside this folder (but `corpus_pipeline.py`) imports it.
"""
