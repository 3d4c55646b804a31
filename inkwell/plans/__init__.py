from inkwell.plans import clustering, corpora, similarity, summaries, topic_modelling

__all__ = ["clustering", "corpora", "similarity", "summaries", "topic_modelling"]
