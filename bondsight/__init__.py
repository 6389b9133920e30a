"""Credit events on bond issuers, and large text corpora, as Spark jobs."""
