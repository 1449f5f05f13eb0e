"""wordspace: word-embedding data jobs written as Spark DataFrame jobs.

Layout
------
sources/    corpus lines, vocabulary and model text readers/writers
functions/  column expressions: vector arithmetic, logistic table, keyed draws
operators/  DataFrame -> DataFrame steps: tokens, vocabulary, sampling,
            sentence chunks, context pairs, Huffman codes, training steps,
            nearest-word and analogy search
plans/      whole jobs composed from operators (fit a model, reports)
streaming/  nothing: the work has no stream form (see its docstring)
"""

__version__ = "0.1.0"
