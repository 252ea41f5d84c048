"""Training-data operators: PII, near-duplicates, quality, toxicity, packing,
perplexity rules, lattice scoring, language, fingerprints, BPE, collocations,
decontamination and lexical search.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
