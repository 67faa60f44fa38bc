"""Alignments and references: derived, SAM text, FASTA, BAM."""
