"""Move, reconcile and replicate tables with Spark plans."""
