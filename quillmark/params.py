"""Constants of the jobs, in one place."""

CONTENT_LANGUAGE = "en"
#: Words of a passage and words from one passage's start to the next's.
SIZE, STRIDE = 64, 32
#: Blocks of STRIDE words whose positions add up together.
BLOCKS = 64
#: BM25.
K1, B = 1.2, 0.75
#: Terms in more than this share of the passages are dropped from questions; of the others the rarest stay.
MAX_DF_SHARE, MAX_TERMS = 0.01, 16
#: Passages cited for a question, and from one source.
TOP_K, PER_SOURCE = 5, 1
#: Words 2 to 1 + ANCHOR of a quote find its sources.
ANCHOR = 8
KEY_TERMS, SUMMARY = 10, 5
#: Terms of a sentence of a summary; terms whose idf bounds sentences exactly (24 bytes each).
LEAST_TERMS, KNOWN = 5, 1 << 18
#: Postings of a slot of the index, and slots at most; passages of a range, about; postings of a term in one piece.
POSTINGS_PER_SLOT, MOST_SLOTS, RANGE, SPLIT = 100_000, 4096, 64, 100_000
#: Characters of the runs by which parts of words are found.
GRAM = 3
