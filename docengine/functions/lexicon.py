"""Word lists, weights and thresholds that results depend on."""

from __future__ import annotations

# Literal replacements after Unicode normalisation: characters and what they become.
REPLACED_BY_BLANK = " "
REMOVED = "\u200b\u200c\u200d\ufeff\x00"
DOUBLE_QUOTES, SINGLE_QUOTES = "“”", "‘’"
DASHES = "–—−•▪■●◦·"

SECTION_HEADERS = ("eligibility criteria", "plan details", "about us", "wait periods", "policy details", "optional benefits", "coverage", "benefits")
CLAUSE_PATTERN = r"up to|coverage|sum insured|benefit|shall|applicable|limit|deductible|co[- ]?payment"
EXCLUSION_PHRASES = ("not covered", "excluded", "does not cover", "waiting period", "pre-existing")
CLAIM_PHRASES = ("co-payment", "deductible", "claim", "reimbursement", "limit per year")
PARENT_KEYWORDS = ("coverage", "benefit", "plan", "eligibility", "policy", "details", "sum insured")
INDEX_CLAUSE_WORDS = ("cover", "covered", "hospitalization", "benefit", "eligibility")
CAPTION_PATTERN = r"^\s*(figure|fig\.?|image|chart|diagram|table)"
DOC_TYPES = {
    "Policy": "policy", "Claim": "claim", "CIS": "cis", "Coverage": "coverage", "Exclusions": "exclusions", "Brochure": "brochure",
    "PreAuth": "preauth", "Proposal": "proposal", "Policy Usage Guide": "usage_guide",
}

# Ordered: the first pattern that matches names the intent.
FIRST_INTENTS = {
    "coverage": r"\b(cover|covered|coverage|include|included|benefit|eligible)\b",
    "exclusion": r"\b(exclusion|excluded|not covered|not cover|denied)\b",
    "claim": r"\b(claim|claiming|reimbursement|reimburse)\b",
    "claim_status": r"\b(claim status|track claim|claim progress|status)\b",
    "cashless": r"\b(cashless)\b",
    "hospital": r"\b(hospital)\b",
    "network_hospital": r"\b(network hospital|empanelled hospital)\b",
    "waiting_period": r"\b(waiting period|waiting|cooling period)\b",
    "renewal": r"\b(renew|renewal)\b",
    "portability": r"\b(portability|port policy|switch policy)\b",
    "co_payment": r"\b(co-payment|co payment|copay)\b",
    "deductible": r"\b(deductible)\b",
    "room_rent": r"\b(room rent|icu rent)\b",
    "premium": r"\b(premium|price|cost|amount)\b",
    "sum_insured": r"\b(sum insured|coverage amount|insured amount)\b",
    "grace_period": r"\b(grace period)\b",
    "pre_existing": r"\b(pre existing|pre-existing)\b",
    "maternity": r"\b(maternity|pregnancy|delivery)\b",
    "comparison": r"\b(compare|comparison|difference|vs|versus)\b",
    "definition": r"\b(what is|meaning|define|definition)\b",
}
OTHER_INTENTS = ("recommendation", "general")
ROUTER_INTENTS = {
    "exclusion": r"\b(exclude|exclusion|not covered|not payable|denied)\b",
    "coverage": r"\b(cover|coverage|covered|benefit|eligible)\b",
    "claim": r"\b(claim|claim process|how to claim|settlement)\b",
    "premium": r"\b(premium|cost|price|amount)\b",
    "waiting_period": r"\b(waiting period|wait time|cooling)\b",
    "definition": r"\b(what is|define|meaning of)\b",
}
BENCHMARK_INTENTS = {
    "exclusion": r"\b(exclude|excluded|not covered|exclusion|denied)\b",
    "claim": r"\b(claim|claim process|file a claim|settlement)\b",
    "premium": r"\b(premium|cost|price|amount)\b",
    "waiting_period": r"\b(waiting period|waiting|cooling)\b",
    "comparison": r"\b(compare|versus|vs)\b",
    "coverage": r"\b(cover|covered|benefit|eligible|room rent)\b",
}
SMALL_TALK = ("hi", "hello", "hey", "thanks", "thank you", "good morning", "good evening", "good afternoon", "who are you", "help")
COMPARISON_PATTERN = r"\b(vs|versus|compare|comparison|difference|better|which|or)\b"
QUERY_FIXES = {"c0ver": "cover", "per0d": "period", "h0spital": "hospital", "p0licy": "policy", "clalm": "claim", "lnsurance": "insurance", "beneflt": "benefit", "dlabetes": "diabetes"}
SYNONYMS = {"waiting period": "wait time", "cover": "coverage", "exclude": "exclusion", "premium": "price", "claim": "reimbursement"}
QUERY_FILLER = r"\b(what is|please tell me|can you|i want to know)\b"
OFF_DOMAIN = ("alien", "zombie", "dragon", "spaceship", "martian", "ghost", "teleport", "magic", "nuclear war", "superpower")

TYPE_BOOST = {"table_row": 0.10, "table_row_part": 0.10, "table_meta": 0.05, "clause": 0.12, "exclusion": 0.20, "definition": 0.08, "list": 0.05, "narrative": 0.0}
TABLE_BOOST = 0.08
RERANK_BOOST = {"exclusion": 0.05, "clause": 0.03, "table_row": 0.02}
VECTOR_WEIGHT, BM25_WEIGHT = 0.70, 0.30
BM25_K1, BM25_B, EPSILON = 1.5, 0.75, 1e-6
FINAL_WEIGHTS = (0.5, 0.4, 0.1)  # retrieval, rerank, intent
STOPWORDS = ("what", "is", "the", "a", "an", "do", "does", "this", "that", "are", "of", "and", "in", "for", "to", "how", "when", "where", "which")
BIAS_TERMS = ("obviously", "everyone knows", "clearly stupid", "always lies", "never trustworthy", "all insurers are scams")
COMPRESS_SENTENCES, COMPRESS_JACCARD, COMPRESS_BUDGET = 4, 0.65, 1800
VERDICT = {"faithfulness": 0.2, "relevance": 0.15, "completeness": 0.001, "coverage": 0.1, "top_score": 0.45}
INVALID_TAG_PENALTY = 0.3
# What a corrective pass can mend, and what it widens the search by.
RETRYABLE = ("low_relevance", "low_faithfulness", "hallucinated_citation", "no_supporting_chunks", "low_coverage", "retrieval_low_confidence")
WIDER, SLIGHTLY_WIDER, WIDEST, DRIFT = 8, 2, 30, 0.65
PROFILE_SLOTS = {
    "coverage_limit": ("sum insured", "coverage"), "room_rent": ("room rent",), "icu_charges": ("icu",), "co_payment": ("co-payment", "copayment"),
    "network_hospitals": ("hospital",), "day_care": ("day care",), "maternity": ("maternity",), "no_claim_bonus": ("no-claim", "bonus"),
}
SESSION_TURNS, SESSION_SECONDS = 20, 3600
