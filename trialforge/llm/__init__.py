"""Operators for preparing language-model training text.

Nothing outside this subpackage imports it; the query registry in
``__spark_entry__`` adds its queries when it can be imported.
"""
