"""DataFrame -> DataFrame operators of the word-embedding jobs."""
