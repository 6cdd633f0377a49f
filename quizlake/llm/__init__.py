"""Training-data operators on document tables; queries in ``queries``, SQL in ``oracle``."""
