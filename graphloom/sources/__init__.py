"""Readers and writers of networks, scores, signatures and alignments."""
