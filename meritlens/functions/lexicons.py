"""Word lists, weights and rules that results depend on.

All of these are fixed values.
"""

AI_TITLES = (
    "ai engineer", "senior ai engineer", "lead ai engineer", "ml engineer", "machine learning engineer",
    "senior machine learning engineer", "applied ml engineer", "recommendation systems engineer", "search engineer",
    "nlp engineer", "senior nlp engineer", "senior software engineer (ml)", "data scientist", "senior data scientist",
)
ADJACENT_TITLES = (
    "backend engineer", "data engineer", "senior data engineer", "analytics engineer", "software engineer",
    "senior software engineer", "full stack developer", "cloud engineer", "devops engineer", "python developer",
    "java developer",
)
NON_TECH_TITLES = (
    "hr manager", "marketing manager", "sales executive", "accountant", "operations manager", "customer support",
    "graphic designer", "content writer", "civil engineer", "mechanical engineer", "project manager", "business analyst",
)
SERVICE_COMPANIES = (
    "tcs", "infosys", "wipro", "accenture", "cognizant", "capgemini", "mindtree", "hcl", "tech mahindra", "mphasis",
)
PRODUCT_COMPANIES = (
    "swiggy", "zomato", "razorpay", "cred", "flipkart", "meesho", "nykaa", "inmobi", "ola", "zoho", "freshworks",
    "policybazaar",
)
RETRIEVAL_TERMS = (
    "retrieval", "ranking", "ranker", "search", "recommendation", "recommender", "recommendations", "personalization",
    "personalisation", "matching", "bm25", "hybrid search", "semantic search", "candidate matching", "talent matching",
)
VECTOR_TERMS = (
    "embedding", "embeddings", "vector", "faiss", "pinecone", "weaviate", "qdrant", "milvus", "opensearch",
    "elasticsearch", "ann", "nearest neighbor", "nearest neighbour", "sentence-transformers", "bge", "e5",
)
ML_TERMS = (
    "machine learning", "ml", "ai", "llm", "rag", "nlp", "fine-tuning", "fine tuning", "lora", "qlora", "peft", "python",
    "pytorch", "tensorflow", "scikit", "xgboost", "lightgbm", "feature engineering", "model serving",
)
EVAL_TERMS = (
    "ndcg", "mrr", "map", "a/b", "ab test", "a/b test", "offline evaluation", "online evaluation", "evaluation framework",
    "offline metric", "online metric", "offline-to-online", "relevance", "precision", "recall",
)
PRODUCTION_TERMS = (
    "production", "deployed", "shipped", "real users", "scale", "latency", "index refresh", "regression", "user-facing",
    "real-time", "monitoring", "drift", "refresh", "pipeline", "served", "launched", "owned",
)
SHALLOW_AI_TERMS = ("curious about ai", "chatgpt", "ai tools", "productivity", "content creation", "experimented with")

MUST_CUES = (
    "must have", "must-have", "you must", "required", "requirement", "you need", "absolutely need",
    "things you absolutely need", "we need", "you should have",
)
NICE_CUES = (
    "nice to have", "nice-to-have", "bonus", "plus", "preferred", "would like you to have", "things we'd like",
    "good to have",
)
DISQUALIFIER_CUES = (
    "will not move forward", "we will not", "do not want", "don't want", "disqualif", "we explicitly do not",
    "not a fit", "we won't", "red flag",
)
EMPHASIS_CUES = ("must", "required", "strong", "absolutely", "essential", "critical", "expect")
CITIES = (
    "Pune", "Noida", "Delhi", "Gurgaon", "Gurugram", "Mumbai", "Hyderabad", "Bangalore", "Bengaluru", "Chennai",
    "Kolkata", "Ahmedabad", "Remote", "Trivandrum", "Kochi", "Vizag",
)
STOPWORDS = (
    "the", "and", "a", "an", "of", "to", "with", "for", "in", "on", "or", "you", "your", "we", "our", "have", "has", "is",
    "are", "be", "been", "that", "this", "it", "as", "at", "by", "from", "must", "should", "will", "not", "no", "any",
    "who", "what", "how", "their", "them", "they", "i", "me", "us", "but", "if", "real", "users", "experience",
    "production", "work", "years", "year", "role",
)
SHORT_SKILLS = (
    "go", "r", "c", "ml", "ai", "js", "qa", "ux", "ui", "bi", "c#", "c++", ".net", "ci", "cd", "ab", "nlp", "llm",
)
DEFAULT_LOCATIONS = ("Bangalore", "Pune", "Hyderabad", "Mumbai", "Delhi", "Noida", "Gurgaon")

MUST, NICE, DISQUALIFIER = "must_have", "nice_to_have", "disqualifier"
KIND_WEIGHTS = {MUST: 1.0, NICE: 0.4, DISQUALIFIER: 1.0}
EMPHASIS = 1.25

FACTORS = ("technical_evidence", "career_fit", "seniority", "logistics", "behavioral", "trust")
CATEGORY_WEIGHTS = {
    "ai_ml_search_ranking": (0.34, 0.22, 0.10, 0.10, 0.17, 0.07),
    "backend_engineering": (0.30, 0.24, 0.12, 0.10, 0.16, 0.08),
    "data_analytics": (0.26, 0.28, 0.12, 0.10, 0.16, 0.08),
    "product_management": (0.20, 0.32, 0.12, 0.10, 0.16, 0.08),
    "sales_gtm": (0.18, 0.34, 0.12, 0.10, 0.16, 0.08),
    "design_product": (0.22, 0.30, 0.12, 0.10, 0.16, 0.08),
}

RISK_PENALTIES = {
    "non_tech_ai_keyword_stuffing": 0.22,
    "ai_terms_without_career_evidence": 0.16,
    "expert_skills_zero_duration": 0.12,
    "service_only_without_product_search_evidence": 0.12,
    "stale_low_response": 0.10,
    "shallow_ai_tool_interest": 0.10,
}
UNKNOWN_RISK_PENALTY = 0.05
IMPOSSIBLE_CODES = ("tenure_exceeds_experience", "expert_zero_duration", "date_integrity", "skill_exceeds_career")

#: Field-name pattern, dimension, how the value is scaled; the first pattern that fits a name counts.
SIGNAL_RULES = (
    (r"open.?to.?work|available|actively.?looking", "availability", "flag"),
    (r"notice.?period|notice.?days", "availability", "notice"),
    (r"willing.?to.?relocate|relocat", "availability", "flag"),
    (r"last.?active|days.?since.?login", "availability", "recency"),
    (r"response.?rate|reply.?rate", "engagement", 1.0),
    (r"response.?time|reply.?hours|reply.?time", "engagement", "hours"),
    (r"saved.?by.?recruiters|recruiter.?saves", "engagement", 15.0),
    (r"profile.?views", "engagement", 150.0),
    (r"search.?appearance", "engagement", 150.0),
    (r"interview.?completion", "engagement", 1.0),
    (r"applications.?submitted", "engagement", 10.0),
    (r"verified.?email|is.?email.?verified", "trust", "flag"),
    (r"verified.?phone|is.?phone.?verified", "trust", "flag"),
    (r"linkedin.?connected|external.?profile.?linked", "trust", "flag"),
    (r"profile.?completeness|completeness", "trust", 100.0),
    (r"github.?activity", "trust", 100.0),
    (r"offer.?acceptance", "trust", 1.0),
    (r"endorsements.?received", "trust", 100.0),
)
RESERVED_ACCOUNTS = ("about", "features", "pricing", "topics", "orgs", "sponsors")
COUNTED_KEYWORDS = (
    "embeddings", "embedding", "retrieval", "ranking", "ranker", "nlp", "ml", "ai", "python", "search", "recommendation",
    "bm25", "faiss", "vector",
)
