"""Operators for preparing large training corpora, one module each:

quality    nearest-neighbour quality classifier      lines      fuzzy line dedup
embed      embedding near-dedup                      packing    best-fit packing
counts     token counts at every prefix              quotes     quotation linking
mih        exact top-k over binary codes             simhash    SimHash near-dedup
repair     token-id files as Re-Pair grammars        wordtable  BPE through a distinct-word table
turns      conversation structure repair             mixture    sources mixed to target weights
lexical    ranked lexical search

``queries`` registers one query per operator.  Nothing else in the package imports this one.
"""
