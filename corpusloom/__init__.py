"""corpusloom: DataFrame-to-DataFrame operators for text corpora, tokenizers and retrieval evaluation."""
