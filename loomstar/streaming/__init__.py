"""An extension: transcripts that grow while they are read."""
