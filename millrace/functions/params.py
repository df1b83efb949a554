"""Fixed values of the retrieval algebra."""

# Limits, window sizes and scoring constants that results depend on.
MAX_UPLOAD_BYTES = 524_288_000
CHUNK_WORDS, CHUNK_OVERLAP, MAX_CHUNKS = 150, 30, 20_000
EMBED_DIM, EPS = 384, 1e-12
BM25_K1, BM25_B = 1.5, 0.75
RRF_K = 60
DEPTH = 50
NOT_FOUND = "Not found in the document."

# File name extensions by kind.
PDF_EXT = (".pdf",)
TEXT_EXT = (".txt", ".md", ".markdown", ".csv", ".tsv", ".json", ".xml", ".log", ".yaml", ".yml", ".ini", ".tex", ".rst")
MARKUP_EXT = (".html", ".htm", ".rtf")
ZIP_EXT = (".docx", ".odt", ".pptx", ".xlsx", ".epub")
IMAGE_EXT = (".png", ".jpg", ".jpeg", ".webp", ".gif", ".bmp", ".tif", ".tiff")
ALLOWED_EXT = PDF_EXT + TEXT_EXT + MARKUP_EXT + ZIP_EXT + IMAGE_EXT

# The words that aren't indexed.
STOPWORDS = tuple(
    "a an and are as at be but by for from has have he her his i if in into is it its of on or "
    "our she so that the their them then there these they this to was we were what when which "
    "who will with you your".split()
)
