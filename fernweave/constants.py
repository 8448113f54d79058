"""Fixed values of the retrieval and graph semantics."""

from __future__ import annotations

# Label weights of graph nodes.
LABEL_WEIGHTS = {
    "Formula": 1.45,
    "Prescription": 1.25,
    "Herb": 1.15,
    "Symptom": 1.15,
    "Syndrome": 1.15,
    "Treatment": 1.1,
    "Indication": 0.95,
    "Function": 0.9,
    "Meridian": 0.65,
    "Flavor": 0.6,
    "Property": 0.6,
    "Dosage": 0.18,
    "Dose": 0.12,
    "Alias": 0.25,
    "Source": 0.22,
    "TextSource": 0.22,
    "ExternalSource": 0.22,
    "DistributionArea": 0.28,
    "Category": 0.08,
    "Evidence": 0.08,
}

# Relation weights of graph edges.
RELATION_WEIGHTS = {
    "COMPOSED_OF": 1.25,
    "HAS_PRESCRIPTION": 1.1,
    "TREATS": 1.0,
    "HAS_FUNCTION": 0.85,
    "MANIFESTS_AS": 1.0,
    "RECOMMENDS_TREATMENT": 1.0,
    "ENTERS_MERIDIAN": 0.45,
    "HAS_FLAVOR": 0.4,
    "HAS_PROPERTY": 0.4,
    "DISTRIBUTED_IN": 0.22,
    "HAS_ALIAS": 0.16,
    "FROM_SOURCE": 0.12,
    "HAS_DOSE": 0.08,
    "INCLUDES": 0.05,
}
DEFAULT_WEIGHT = 1.0

# Domain terms that queries are searched for.
TERMS = (
    "柴胡桂枝干姜汤",
    "心脾两虚",
    "肝阳上亢",
    "肝火上炎",
    "补益心脾",
    "归脾汤",
    "党参",
    "柴胡",
    "桂枝",
    "干姜",
    "失眠",
    "不寐",
    "证候",
    "中药",
    "方剂",
    "症状",
    "治法",
)

# Everyday words and the terms they stand for.
TERM_ALIASES = {
    "睡不着": ("失眠", "不寐"),
    "入睡困难": ("失眠", "不寐"),
    "夜寐不安": ("失眠", "不寐"),
    "偏头疼": ("头痛",),
}

# Words without meaning for a search.
STOP_WORDS = (
    "可以", "哪些", "什么", "怎么", "如何", "处理", "关联", "组成", "分析", "从",
    "吗", "呢", "的", "了", "和", "与", "及", "或", "是", "为",
)

# Weights of fused scores, candidate counts, size limits, coverage targets.
TOKEN_WEIGHT, VECTOR_WEIGHT, RERANK_WEIGHT = 0.3, 0.7, 0.5
LEXICAL_CANDIDATES, CHUNK_TOP_K, GRAPH_TOP_K, MAX_PATHS = 80, 8, 56, 40
MIN_TOKENS, MAX_TOKENS = 8, 900
PARENT_TARGET, PARENT_MAX, CHILD_TARGET, CHILD_MAX = 2400, 4000, 360, 520
MIN_COVERAGE, MAX_ODD_LENGTH = 0.8, 0.2
UNIGRAM_WEIGHT, PAIR_WEIGHT = 4, 6  # tenths, so that sums are exact
