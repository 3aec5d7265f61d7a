"""Job specifications. Term lists are fixed values: results depend on them word for word."""

from __future__ import annotations

from sieveline.schema import JobSpec

# The senior AI engineer specification.
AI_ENGINEER = JobSpec(
    family="AI Engineer",
    keywords=(
        "embeddings", "embedding", "retrieval", "ranking", "recommendation", "recommender",
        "semantic search", "vector search", "hybrid search", "information retrieval",
        "learning to rank", "learning-to-rank", "sentence-transformers", "sentence transformers",
        "bge", "e5", "faiss", "pinecone", "weaviate", "qdrant", "milvus", "elasticsearch",
        "opensearch", "nlp", "natural language", "llm", "large language model", "fine-tuning",
        "fine tuning", "lora", "qlora", "peft", "ndcg", "mrr", "a/b test", "xgboost", "lightgbm",
        "transformer", "bert", "rag", "python", "machine learning", "deep learning",
        "pytorch", "tensorflow", "recommender systems",
    ),
    title_terms=(
        "machine learning", "ml engineer", "ai engineer", "ai research", "ai specialist",
        "applied scientist", "applied ml", "data scientist", "nlp", "search", "relevance",
        "recommendation", "ranking", "research engineer", "ml",
    ),
    req_skills=(
        "python", "pytorch", "tensorflow", "deep learning", "nlp", "machine learning",
        "data science", "feature engineering", "mlops", "transformers",
    ),
    seniority_years=7,
    seniority_min=5.0,
    seniority_max=9.0,
    specialist=(
        "faiss", "pinecone", "qdrant", "weaviate", "milvus", "opensearch", "elasticsearch",
        "semantic search", "vector search", "hugging face", "transformers", "learning to rank",
        "recommender", "recommendation", "information retrieval", "retrieval", "embeddings",
        "rag", "llm", "fine-tuning", "bge", "e5", "sentence-transformers",
    ),
    offdomain_titles=(
        "hr manager", "human resource", "recruiter", "marketing manager", "content writer",
        "graphic designer", "accountant", "sales executive", "sales manager", "customer support",
        "operations manager", "business analyst", "civil engineer", "mechanical engineer",
        "project manager", "product manager",
    ),
    relevant_titles=(
        "ml engineer", "machine learning", "ai research", "ai engineer", "ai specialist",
        "data scientist", "recommendation systems engineer", "applied scientist", "nlp engineer",
        "search engineer", "relevance engineer", "data engineer", "analytics engineer",
        "backend engineer", "software engineer", "senior software engineer (ml)",
    ),
    narrow_domain=("computer vision", "speech", "robotics", "image"),
    counter_domain=(
        "nlp", "natural language", "information retrieval", "semantic search",
        "retrieval", "ranking", "recommender", "recommendation",
    ),
    consulting=(
        "tcs", "tata consultancy", "infosys", "wipro", "accenture", "cognizant", "capgemini",
        "tech mahindra", "hcl", "ltimindtree", "lti", "mindtree", "mphasis", "l&t infotech",
        "larsen & toubro", "hexaware", "cybage", "birlasoft", "coforge", "mastek", "zensar",
        "ntt data", "nttdata", "dxc", "igate", "syntel", "sonata software",
    ),
    research_markers=(
        "research assistant", "research scholar", "postdoc", "post-doc", "phd researcher",
        "phd student", "academia", "academic", "university of", "laboratory", "professor",
        "lecturer",
    ),
    production_markers=(
        "production", "deployed", "shipped", "at scale", "users", "latency", "throughput",
        "pipeline", "api", "service", "real-time", "real time", "product", "customers",
    ),
    preferred_cities=(
        "pune", "noida", "hyderabad", "mumbai", "delhi", "gurgaon", "gurugram",
        "bangalore", "bengaluru", "ncr",
    ),
    home_places=(
        "pune", "noida", "hyderabad", "mumbai", "delhi", "gurgaon", "gurugram", "bangalore",
        "bengaluru", "ncr", "chennai", "kolkata", "ahmedabad", "indore", "jaipur", "chandigarh",
        "coimbatore", "kochi", "trivandrum", "bhubaneswar", "vizag", "india",
    ),
)

# Weights of the ranking that this specification is for.
RELATIVE_WEIGHTS = {
    "semantic_sim": 2.0, "bm25_score": 0.4, "title_similarity": 3.0, "skill_coverage": 1.5,
    "specialist_skill_bonus": 2.5, "seniority_alignment": 1.0, "quality_score": 0.4,
    "hireability_score": 1.5, "startup_readiness": 0.5, "behavioral_reliability": 0.5,
    "location_fit": 0.75, "retrieval_fusion": 1.0, "offdomain_title_penalty": -4.0,
    "keyword_trap_penalty": -3.0, "research_only_penalty": -2.0, "narrow_domain_penalty": -1.5,
}

# Families, weights and trap titles of the family rankings.
ROLE_FAMILIES = {
    "Search Engineer": ("search", "retrieval", "relevance", "ranking", "nlp", "machine learning", "ai", "data scientist", "ml"),
    "Frontend Engineer": ("frontend", "ui", "ux", "client", "web", "javascript", "react", "angular", "vue", "front-end"),
    "Sales Manager": ("sales", "revenue", "business development", "gtm", "growth", "customer success", "account executive", "territory"),
}
SKILL_FAMILIES = {
    "Search Engineer": ("python", "elasticsearch", "faiss", "machine learning", "nlp", "deep learning", "pytorch", "tensorflow", "scikit-learn"),
    "Frontend Engineer": ("javascript", "react", "css", "html", "typescript", "ui/ux", "vue", "angular", "redux", "next.js"),
    "Sales Manager": ("sales", "crm", "b2b", "negotiation", "leadership", "pipeline", "salesforce", "marketing", "quota"),
}
TRAP_TITLES = ("marketing", "sales", "hr", "recruiter", "manager", "project manager", "product manager", "analyst", "support", "executive", "director", "accountant")
FAMILY_WEIGHTS = {"title_affinity": 2.5, "skill_affinity": 3.5, "career_affinity": 2.5, "semantic_sim": 1.0, "bm25_score": 1.0, "quality_score": 1.0}
TRANSFERS = {
    "neural networks": "ai", "tensorflow": "machine learning", "pytorch": "deep learning",
    "faiss": "vector search", "qdrant": "vector database", "learning to rank": "search relevance",
}

# The pool ranking's specification and weights.
POOL_SEARCH = JobSpec(
    family="Search Engineer",
    keywords=("faiss", "pinecone", "elasticsearch", "search", "ranking", "retrieval", "machine learning", "python"),
    title_terms=("search", "machine learning", "ai", "ml", "data scientist", "backend", "nlp", "retrieval", "ranking"),
    req_skills=("python", "elasticsearch", "faiss", "machine learning"),
    consulting=("tcs", "infosys", "wipro", "accenture", "cognizant", "capgemini"),
)
POOL_WEIGHTS = {
    "title_similarity": 4.95, "semantic_sim": 2.18, "skill_coverage": 1.23, "seniority_alignment": 0.88,
    "quality_score": 0.81, "bm25_score": 0.62, "keyword_stuffing_risk": -7.31,
    "hireability_score": 0.5, "startup_readiness_score": 0.5, "behavioral_reliability_score": 0.5,
}
ANTI_SKILLS = {"hr": 1.0, "recruiter": 1.0, "accountant": 1.0, "marketing": 0.8, "sales": 0.6}

# The showcase's term lists.
SHOWCASE_SKILLS = (
    "python", "faiss", "qdrant", "elasticsearch", "machine learning", "nlp", "learning to rank",
    "information retrieval", "embeddings", "vector search", "opensearch", "pinecone", "ranking",
    "retrieval", "search",
)
SHOWCASE_PROFILE = ("search", "retrieval", "ranking", "recommendation", "nlp", "ml engineer", "machine learning")
SHOWCASE_CAREER = ("ranking", "retrieval", "search", "relevance", "faiss", "embedding", "vector", "learning-to-rank")
