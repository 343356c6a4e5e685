"""Analytics over the data of engineering drawings, as Spark plans."""
