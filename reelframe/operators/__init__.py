"""DataFrame operators over clips, words, samples and frames."""
