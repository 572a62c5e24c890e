"""DataFrame -> DataFrame operators over recordings, transcripts, vectors and the catalog.

Every operator takes its keys (one recording or group) and an explicit order;
results carry ordinals instead of relying on row order.
"""
