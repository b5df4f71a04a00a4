"""Training-data operators: extraction, quality, language, deduplication,
decontamination, scoring and mixing over the text tables.

Nothing else in the library imports this subpackage.
"""
