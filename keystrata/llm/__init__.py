"""Operators of a training-data pipeline.

One module for each operator; ``queries`` registers them.  Nothing outside this
subpackage (but ``corpus_pipeline.py``) imports it.
"""
