"""Operators for building training corpora (``concord.llm``).

A self-contained subpackage: nothing else in the library imports it.  Each
module is one operator with a DataFrame interface; ``queries.py`` registers
the thin ``opN_<name>`` driver queries over it.
"""
