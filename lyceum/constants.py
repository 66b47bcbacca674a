"""Values that results depend on.

Fixed values: word lists, patterns, weights and limits below are part of the
semantics of the queries and stand here in one place.
"""

STOP_TERMS = ["a", "an", "and", "are", "as", "between", "do", "does", "for", "how", "in", "is", "it", "of", "or", "the", "to", "what", "when", "why"]
LOGISTICS_TERMS = [
    "assignment", "assignments", "before", "covered", "quiz", "quizzes", "exam", "final",
    "grading", "grade", "deadline", "deadlines", "schedule", "calendar", "syllabus",
    "lecture", "lectures", "midterm", "review", "topic", "topics", "week", "weeks", "when",
]
OUT_OF_SCOPE_TERMS = ["cafeteria", "canteen", "menu", "weather", "stock", "price", "president", "restaurant", "flight", "hotel"]
BROAD_TERMS = ["everything", "anything", "overview", "summarize", "summary", "tell"]
COMMON_WORDS = [
    "the", "and", "for", "are", "how", "what", "when", "why", "who", "which", "where", "does", "can", "could", "would",
    "should", "you", "your", "this", "that", "these", "those", "with", "from", "about", "into", "there", "their", "have",
    "has", "was", "were", "will", "tell", "explain", "give", "show", "please", "some", "any", "use", "used", "get",
]
FIGURE_TERMS = ["figure", "figures", "plot", "plots", "image", "images"]
COMPARISON_TERMS = ["difference", "differences", "compare", "comparison", "versus", "vs"]
REFERENTIAL_TERMS = ["it", "this", "that", "they", "them"]
SMALL_WORDS = ["a", "an", "and", "as", "at", "by", "for", "in", "of", "on", "or", "the", "to", "vs", "with"]
IGNORED_FOLDERS = [".git", "_build", ".ipynb_checkpoints", "__pycache__", "node_modules", ".venv"]
TIME_SENSITIVE_FILES = ["syllabus.md", "calendar.md"]

BM25_K1, BM25_B = 1.5, 0.75
FUSION_LEXICAL, FUSION_MEANING = 0.45, 0.55
BOOST_TEMPORAL, BOOST_PHRASE, BOOST_TITLE_PHRASE, BOOST_COMPARISON, FIGURE_FACTOR = 0.25, 0.10, 0.18, 0.14, 0.82
TOP_K, CANDIDATES = 5, 30
WEAK_SCORE, MIN_MEANING, MIN_LEXICAL = 0.42, 0.18, 0.01
LEADER_RATIO, MEANING_FLOOR, MEANING_MARGIN, KNOWN_SHARE = 0.72, 0.20, 0.10, 0.5
BROAD_TOKENS = 4
EVIDENCE_SCORE = 0.60
MEMORY_TURNS, MEMORY_CHARS, MEMORY_SEARCH_CHARS, CONTEXT_TERM_CHARS = 4, 1200, 400, 160
SELECTION_CHARS, SELECTION_SEARCH_CHARS = 1500, 600
CHUNK_MAX, CHUNK_MIN, TOKENS_PER_WORD = 400, 100, 1.33
CONCEPT_SIMILARITY, TOPIC_SIMILARITY, TOPIC_SHARED, CHAPTER_SHARED, DEGREE_CAP = 0.10, 0.12, 2, 3, 3
PATH_CONCEPTS = 3
NEIGHBOUR_LIMITS = {"keyword": 8, "topic": 6, "chapter": 16}
OTHER_LINKS = 30
FEEDBACK_PER_DAY = 100
FEEDBACK_CHARS = {"question": 1000, "answer": 6000, "note": 1000, "page": 300}
MIN_SHARED_PAPERS, MAX_AUTHORS = 3, 6

NEXT_ACTIONS = {
    "answerable": "answer_from_course_evidence",
    "needs_time_context": "answer_with_time_context",
    "needs_clarification": "ask_clarifying_question",
    "weak_evidence": "return_insufficient_course_evidence",
    "out_of_scope": "refuse_or_consider_web_fallback",
}
OUTCOMES = {
    "answerable": "answered",
    "needs_time_context": "answered, with the course term",
    "needs_clarification": "too broad (asked to narrow it)",
    "weak_evidence": "not in the notes",
    "out_of_scope": "outside the course",
}

#: Headings of a chapter's index page by what stands below them, and words that keep a line out of outlines.
OVERVIEW = r"(?i)\b(content|contents|overview|introduction|intro|about|summary|description|this (chapter|week|lecture))\b"
OBJECTIVE = r"(?i)\b(objectives?|outcomes?|goals?|aims?|you will learn|you'll learn|what you will)\b"
SKIP = r"(?i)\b(slides?|videos?|recordings?|zoom|readings?|references?|assignments?|homework|links?|resources?)\b"
PRIVATE = r"(?i)zoom|passcode|password|log ?in|recorded|recording"
