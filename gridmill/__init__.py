"""gridmill: data operators for neighbourhood-scale mobility analytics on Spark."""
