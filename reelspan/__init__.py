"""Reelspan: selecting and captioning moments over whole video corpora, as Spark jobs."""
