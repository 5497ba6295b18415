"""Operators of a training-data pipeline: language, tokens, near copies, quality, licences, mixing and packing.

``queries`` registers one query per operator; every other module is one operator or a helper of several.
"""
