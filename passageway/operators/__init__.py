"""Operators, one module per stage: corpus, encode, retrieve, cite, evaluate, trainmix."""
