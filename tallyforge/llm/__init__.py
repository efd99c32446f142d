"""Training-data operators: toxicity, decontamination, URL and secret filters,
language-model scoring, near-duplicate joins, tokenizer counts, fingerprints,
BPE and preference formatting.  Nothing else in the library imports this
subpackage."""
