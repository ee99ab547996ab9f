"""Operators for preparing language-model training data at corpus scale.

The rest of the library imports nothing from here; ``queries`` holds the
registered queries and their SQL, ``pipeline_stages`` the corpus pipeline's.
"""
