from inkwell.functions import han, kernels, stopwords, text, vectors

__all__ = ["han", "kernels", "stopwords", "text", "vectors"]
