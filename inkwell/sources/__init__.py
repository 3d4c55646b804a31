from inkwell.sources import corpus, vectors

__all__ = ["corpus", "vectors"]
