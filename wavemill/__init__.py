"""wavemill: multichannel-signal analytics expressed as Spark DataFrame jobs."""
