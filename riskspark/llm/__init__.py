"""Operators of a training-data pipeline: one module per operator.

Every operator takes and returns DataFrames and keeps a general interface; the
``opN_<name>`` queries in ``queries`` apply them to whole tables.
"""
