"""Fixed values of the data model, in natural order."""

from __future__ import annotations

# Node types and their older English labels.
NODE_TYPES = {
    "药材": "Herb", "饮片": "PreparedHerb", "成分": "Component", "品种": "Variant", "工艺": "Process", "性状": "Trait",
    "功效": "Efficacy", "性味": "Flavor", "归经": "Meridian", "病证": "Disease", "症状": "Symptom", "方剂": "Formula",
    "医案": "MedicalCase", "穴位": "Acupoint", "治法": "TreatmentMethod", "时间点": "TimePoint", "来源": "Source", "证据": "Evidence",
}
# Edge types.
EDGE_TYPES = [
    "具有饮片", "包含成分", "提取自", "具有品种", "属于药材", "经过工艺", "适用于", "储存时间", "具有性状", "观察于",
    "具有功效", "具有性味", "归于经脉", "治疗病证", "关联药材", "关联治法", "关联证候", "关联症状", "相互作用", "相似于",
    "父类", "子类", "来源于", "派生自", "由证据支持", "组成药材", "使用方剂", "取用穴位", "采用治法", "记载于医案",
]
# The node types an edge may lead to, in the order in which they are tried.
EDGE_TARGETS = {
    "组成药材": ("药材", "饮片"), "适用于": ("病证",), "使用方剂": ("方剂",), "取用穴位": ("穴位",), "采用治法": ("治法",),
    "治疗病证": ("病证",), "关联药材": ("药材",), "关联治法": ("治法",), "关联证候": ("病证",), "关联症状": ("症状",),
    "记载于医案": ("医案",), "由证据支持": ("证据",), "来源于": ("来源",), "经过工艺": ("工艺",), "具有功效": ("功效",),
    "具有性味": ("性味",), "归于经脉": ("归经",), "具有饮片": ("饮片",), "相似于": ("药材", "方剂", "病证"), "包含成分": ("成分",),
}
# Statuses, stored and shown.
STATUSES = {"pending": "待验证", "verified": "已验证", "rejected": "已拒绝"}
# Labels whose nodes may merge by surface key.
SHARED_LABELS = ("功效", "性味", "归经", "病证", "治法", "穴位", "工艺")
# Properties that give the stable id, the first that is not empty.
STABLE_ID_KEYS = ("snomed_id", "tcmt_id", "cpm_id", "chp_id", "term_code", "icd11_code", "evidence_id")
# Properties that filling never changes.
PROTECTED_KEYS = ("name", "id", "source", "status", "type", "dataset", "category", "description", "indications", "base_description", "verification_id", "verified_by", "verified_at", "imported_at")
# Properties that hold text fragments, which do not go to the graph.
FRAGMENT_KEYS = ("evidence_text", "证据原文", "raw_text", "原文", "source_text", "content", "text", "snippet")
# Whole names that character recognition got wrong, by label.
WHOLE_NAMES = {("性味", "成"): "咸", ("性味", "干"): "甘", ("性味", "淫"): "涩"}
# Trade marks that keep a record from being published.
BRANDS = ("同仁堂", "云南白药", "片仔癀", "东阿阿胶", "哈药", "扬子江", "修正药业", "葵花药业", "999感冒")
