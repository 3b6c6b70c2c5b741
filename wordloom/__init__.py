"""wordloom: text, word-association and graph analytics expressed as Spark plans."""
