"""Values that must equal the published behaviour for results to agree.

Fixed values: word lists, thresholds, weights and limits. Nothing here but
the table of marked letters is derived; the rest of the package imports from
this one place.
"""

import unicodedata

# --- text normalisation -----------------------------------------------------
STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of",
    "with", "by", "is", "are", "was", "were", "be", "been", "being", "have",
    "has", "had", "do", "does", "did", "will", "would", "could", "should",
    "may", "might", "must", "can", "this", "that", "these", "those",
]
MIN_WORD_LENGTH = 3

# --- chunking ---------------------------------------------------------------
CHUNK_SIZE = 2000
CHUNK_OVERLAP = 200
SMALL_CHUNK_SIZE = 512
SMALL_CHUNK_OVERLAP = 64
SEPARATORS = ["\n\n", "\n", ".", "!", "?", ";", " "]
PAGE_MARKER = r"--- Page (\d+) ---"
PAGE_GUESS_LIMIT = 50
CHUNKS_PER_GUESSED_PAGE = 3

# --- search -----------------------------------------------------------------
BM25_K1 = 1.2
BM25_B = 0.75
BM25_MIN_IDF = 1e-6
SEMANTIC_WEIGHT = 0.6
DEFAULT_TOP_K = 5
MAX_TOP_K = 50
# Latin letters with marks and the plain letter each is indexed under: all that decompose into one.
_MARKED = {
    chr(c): unicodedata.normalize("NFD", chr(c))[0]
    for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))
    if chr(c).islower() and len(unicodedata.normalize("NFD", chr(c))) > 1 and unicodedata.normalize("NFD", chr(c))[0].isascii()
}
MARKED_LETTERS = "".join(_MARKED)
PLAIN_LETTERS = "".join(_MARKED.values())

# --- content selection ------------------------------------------------------
MAX_CONTENT_LENGTH = 4000
TARGET_CHUNKS = 5
SMALL_DOCUMENT_CHUNKS = 3
MEDIUM_DOCUMENT_CHUNKS = 10
STRUCTURAL_HEAD_WORDS = ["abstract", "introduction"]
STRUCTURAL_TAIL_WORD = "conclusion"
STRUCTURAL_ANY_WORD = "summary"
STRUCTURAL_SHORT_WORDS = 50
SEMANTIC_PROBES = [
    "introduction abstract summary",
    "conclusion results findings",
    "methodology approach method",
]
QUALITY_WORDS = ["introduction", "abstract", "conclusion", "summary", "findings"]

# --- similarity graph -------------------------------------------------------
COSINE_WEIGHT = 0.6
JACCARD_WEIGHT = 0.3
LENGTH_WEIGHT = 0.1
HIGHLY_SIMILAR = 0.8
SIMILAR_TO = 0.6
RELATED_TO = 0.4
TOLERANCE = 0.001
MIN_EDGE_SIMILARITY = 0.35
COSINE_FLOOR = 0.1
RESOLUTIONS = [0.5, 1.0, 1.5, 2.0]
CENTRALITY_WEIGHTS = {
    "degree": 0.3, "betweenness": 0.3, "closeness": 0.2, "eigenvector": 0.2,
}
PAIR_SUMMARY_STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of",
    "with", "by", "design", "approach", "method", "analysis", "system",
    "neural", "network", "synthesis", "high", "level", "roadmap", "ckks",
    "fhew", "tfhe", "fpga", "ai", "prist",
]
RELATIONSHIP_KEYWORDS = [
    "neural", "network", "synthesis", "design", "analysis", "system",
    "approach", "method",
]

# --- request preparation ----------------------------------------------------
FILLER_WORDS = ["please", "kindly", "would you", "could you", "thank you"]
SHORT_PHRASES = [
    ("please provide", "provide"),
    ("please analyze", "analyze"),
    ("please summarize", "summarize"),
    ("based on the following", "from:"),
    ("please keep the response", "keep response"),
    ("please explain", "explain"),
    ("please describe", "describe"),
]
ANALYSIS_TASKS = {
    "summary": "Summarize this document in 2-3 sentences",
    "headings": "Extract main headings and structure",
    "topics": "Identify 3-5 main topics",
    "entities": "Extract key entities, people, organizations",
    "insights": "Provide 2-3 key insights",
}
DEFAULT_TASK = "Analyze this document"
INSIGHT_DEFAULTS = {
    "sentiment_tone": "analytical",
    "contradictions": "None identified in current analysis",
    "overlap_redundancy": "Related to other document sections",
    "supporting_evidence": "Context available from related document passages",
    "external_contradictions": "External validation can provide additional perspectives",
    "counterpoints": "Multiple viewpoints available for comprehensive analysis",
    "real_world_examples": "Practical applications exist for this topic",
    "surprising_insights": "Further analysis may reveal additional patterns",
    "related_articles": "Academic and professional sources recommended",
}
ANSWER_TTL_DAYS = 7
REQUEST_BATCH = 5

# --- persona scoring --------------------------------------------------------
HEADING_MARKS = ["chapter", "section", "1.", "2.", "3."]
HEADING_BOOST = 1.5
GRADES = [(0.9, "A+"), (0.8, "A"), (0.7, "B"), (0.6, "C"), (0.5, "D")]

# --- uploads and sessions ---------------------------------------------------
MAX_FILES_PER_SESSION = 50
MAX_FILE_MB = 100
SESSION_HOURS = 24

# --- outlines: patterns on lower-cased text -----------------------------------
RUNNING_WORDS = [
    "page", "copyright", "©", "confidential", "draft", "proprietary",
    "all rights reserved",
]
RUNNING_PATTERNS = [
    r"page\s+\d+",
    r"\d+\s+of\s+\d+",
    r"version\s+\d+\.\d+",
    r"(january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{4}",
    r"\d{4}-\d{2}-\d{2}",
    r"www\.",
    r"@",
    r"copyright",
    r"©",
    r"confidential",
    r"draft",
    r"revision\s+history",
    r"table\s+of\s+contents",
]
SPATIAL_RUNNING_PATTERNS = [
    r"page\s+\d+", r"\d+\s+of\s+\d+", r"version\s+\d+\.\d+", r"www\.", r"@",
    r"copyright", r"©", r"confidential", r"^\d+\.\s*$",
]
NOT_A_HEADING_PATTERNS = [
    r"^page \d+", r"^\d+$", r"^[^\p{L}\p{N}_]*$", r"www\.", r"@",
    r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",
]
SECTION_WORDS = [
    "chapter", "section", "introduction", "conclusion", "method", "result",
    "discussion", "abstract", "summary", "background", "analysis", "findings",
    "recommendation",
]

# --- outlines: patterns on the text as written --------------------------------
FORM_FIELD_PATTERNS = [
    r"^\d+\.\s*$", r"^Name\s+of\s+", r"^Date\s+of\s+", r"^Amount\s+of\s+",
    r"^Whether\s+", r"^\([a-z]\)\s+",
]
FORM_ROW_PATTERNS = [
    r"^\d+\.\s+[A-Z][a-z\s]*$",
    r"^\d+\.\s+[A-Z][A-Z\s+]+$",
    r"^[A-Z][a-z\s]*\s+[A-Z][a-z\s]*\s+[A-Z][a-z\s]*$",
    r"^S\.No\s+Name\s+Age",
    r"^\d+\.\s*$",
    r"^Name\s+Age\s+Relationship",
    r"^Signature\s+of\s+Government\s+Servant",
    r"^LTC\s+is\s+to\s+be\s+availed",
]
TITLE_PATTERNS = [
    r"^[A-Z][A-Za-z\s:]+[A-Za-z]$",
    r"^[A-Z][a-z]+\s+[A-Z][a-z\s]+$",
    r"^[\p{L}\p{N}_]+:\s+[^\n]+$",
    r"^[A-Z][A-Z\s]{8,}$",
]
HEADING_PATTERNS = [
    r"^\d+\.\s+[A-Z][^.]*$",
    r"^[A-Z][A-Z\s]{8,}$",
    r"^[A-Z][a-z\s]{10,}$",
    r"^\d+\s+[A-Z][a-z\s]{5,}$",
    r"^\d+\.\d+\s+[A-Z][^.]*$",
    r"^[A-Z][a-z\s]{5,}:\s*$",
    r"^\d+\.\d+\s+[A-Z][a-z\s]{3,}$",
    r"^\d+\.\d+\.\d+\s+[A-Z][^.]*$",
    r"^[A-Z][a-z\s]{3,}:\s*$",
    r"^[A-Z][a-z\s]*[A-Z][a-z\s]*:\s*$",
    r"^For\s+each\s+[A-Z][a-z\s]*it\s+could\s+mean:\s*$",
    r"^[A-Z][a-z\s]{15,}:\s*$",
]
FORM_LIST_PATTERNS = [
    r"^\d+\.\s+(name|date|age|address|phone|email|whether|amount|details?)\s+(of|for)?\s+",
    r"^\d+\.\s+[\p{L}\p{N}_]+\s+(name|date|number|address|details?)\s*:?\s*$",
    r"^\d+\.\s+(signature|declaration|certification)\s+",
]
FORM_DOCUMENT_PHRASES = [
    "Name of", "Date of", "Whether", "Application form", "S.No", "Signature",
]
TABLE_HEADERS = [
    "name", "age", "date", "amount", "description", "type", "status", "id",
]
SENTENCE_WORDS = [
    "the", "and", "of", "to", "in", "for", "with", "by", "from", "that",
    "which", "who",
]
TITLE_WORDS = [
    "introduction", "overview", "background", "methodology", "results",
    "conclusion", "discussion", "analysis", "summary", "abstract",
    "references", "appendix", "definition", "purpose", "scope",
    "requirements", "implementation", "testing",
]
BODY_VERBS = ["will be", "have been", "has been", "are being", "were being"]
BODY_PREPOSITIONS = ["during", "throughout", "within", "between", "among"]
BODY_EXAMPLES = ["including", "such as", "for example", "specifically"]
BODY_WORDS = [
    "the", "and", "that", "this", "with", "from", "they", "have", "will", "been",
]
PARAGRAPH_WORDS = [
    "therefore", "however", "moreover", "furthermore", "consequently",
    "additionally",
]
FLOW_WORDS = [
    "and", "but", "or", "so", "yet", "for", "nor", "as", "if", "when", "while",
    "because", "that", "which", "who", "where", "why", "how",
]
LIST_VERBS = ["who", "that", "which", "have", "been", "will", "are", "would"]
DESCRIPTION_STARTS = [
    "the following", "the above", "each of the", "all of the", "this section",
    "this chapter", "this document", "in order to", "it is important",
    "please note", "as shown in",
]
INSTRUCTION_PATTERNS = [
    r"must be [\p{L}\p{N}_]+", r"should be [\p{L}\p{N}_]+",
    r"will be [\p{L}\p{N}_]+", r"are required to", r"are expected to",
    r"are used in",
]
FUNCTION_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of",
    "with", "by",
]
COMPLEX_WORDS = [
    "therefore", "however", "moreover", "furthermore", "consequently",
    "nevertheless", "although", "whereas", "provided that",
]
