"""Training-data operators: one module per operator, shared helpers in `textbytes`, `pretokens`, `shared` and `components`.

Nothing outside this subpackage and `corpus_pipeline.py` imports it.
"""
