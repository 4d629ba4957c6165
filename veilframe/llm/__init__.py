"""Training-data operators: dedup, packing, chat, classifiers, search, binary output, scans.

Nothing outside this subpackage imports it; ``veilframe.llm.queries`` registers its queries.
"""
