"""Operators of a training-data pipeline: one module per operator, registered in ``queries``.

Nothing outside this package imports it (``__spark_entry__.py`` adds its queries when it is there).
"""
