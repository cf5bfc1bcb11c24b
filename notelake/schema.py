"""Schemas of the library's tables."""

NOTES = "path string, text string, mtime timestamp, size bigint"
RAW_DOCS = "_id string, path string, size bigint, mtime bigint, deleted boolean, children array<string>"
INDEX_NOTES = "path string, mtime double, size bigint, hash string, n_chunks int, indexed_at timestamp"
CHUNKS = "path string, ord int, heading string, hlevel int, ctype string, text string, vec array<float>"
DOC_FREQ = "term string, n bigint"
POSTINGS = "term string, cls int, path string, ord int, tf int, len int"
WEIGHTS = "term string, cls int, n bigint"
SEEN = "path string, seq bigint, deleted boolean, mtime timestamp"
EMBEDDINGS = "h string, vec array<float>"
QUERIES = "qid bigint, query string"
RULES = "category string, pattern string, is_exception boolean"
OPS = "seq bigint, path string, op string, content string, old_text string, to_path string"
CHUNK = "array<struct<ord:int,heading:string,hlevel:int,ctype:string,text:string>>"

#: The tables of an index.
INDEX = {"notes": INDEX_NOTES, "chunks": CHUNKS, "df": DOC_FREQ, "emb": EMBEDDINGS, "postings": POSTINGS, "weights": WEIGHTS, "seen": SEEN}
