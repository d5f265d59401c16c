"""tessera: media-frame and training-data operators expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
