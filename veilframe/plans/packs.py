"""The bundled rule packs, taxonomies and standards.

Fixed values: identifiers, levels, keywords, patterns and priorities are data that results depend on.
"""

from __future__ import annotations

from dataclasses import replace

from veilframe.plans.model import Composite, Downgrade, Matcher, Profile, Rule, Standard, Taxonomy


def _keywords(*words: str, **params) -> Matcher:
    return Matcher("keyword_contains", {"keywords": words, **params}, "field_name")


def _regex(pattern: str) -> Matcher:
    return Matcher("regex", {"pattern": pattern})


MOBILE = r"^1[3-9]\d{9}$"

GENERAL_PII = Profile(
    "general-pii",
    (
        Rule("RULE_PII_IDCARD", "L3", "PERSONAL_BASIC", 100, (Matcher("id_card_checksum"),), "AND"),
        Rule("RULE_PII_PHONE", "L3", "PERSONAL_BASIC", 100, (_regex(MOBILE),), "AND"),
        Rule("RULE_PII_MEDICAL_CARD", "L3", "PERSONAL_BASIC", 100, (Matcher("medical_card_checksum"),), "AND"),
        Rule("RULE_PII_CONTACT", "L3", "PERSONAL_BASIC", 50, (_keywords(
            "email", "mail", "address", "addr", "location", "loc", "gps", "coordinate", "position", "轨迹", "phone", "mobile", "tel", "telephone", "cellphone",
            "call", "dh", "lxfs", "联系电话", "联系方式", "联系地址", "居住地", "家庭住址", "邮编", "zipcode", "postcode"),), "AND"),
        Rule("RULE_PII_BIOMETRIC", "L3", "PERSONAL_BASIC", 50, (_keywords(
            "fingerprint", "voiceprint", "palmprint", "iris", "face", "face_id", "biometric", "dna", "retina", "gait", "指纹", "声纹", "掌纹", "虹膜", "人脸", "人像",
            "生物识别", "步态"),), "AND"),
        Rule("RULE_PII_NAME", "L3", "PERSONAL_BASIC", 40, (_keywords(
            "name", "username", "realname", "fullname", "patient_name", "idcard", "identity", "id_card", "sfz", "身份证", "身份证号", "passport", "护照", "姓名", "真实姓名",
            "用户姓名"),), "AND"),
        Rule("RULE_PII_BANK_CARD", "L3", "PERSONAL_BASIC", 50, (_keywords("bank_card", "bank_account", "card_no", "account_no", "银行卡", "卡号", "还款账户", "银行账户"),), "AND"),
    ),
    (
        Downgrade("general-pii:RULE_DOWN_PUBLIC", ("public_report", "annual_summary", "科普", "公开", "public", "notice", "announcement", "公告", "公示"), "L1", "PUBLIC_REPORT", False, ""),
        Downgrade("general-pii:RULE_DOWN_OPS", (
            "turnover_rate", "device_usage", "inventory", "statistics", "stat_count", "total_cnt", "total_num", "stat_num",
            "门诊人次", "床位统计", "工作量统计", "周转率", "使用率", "库存", "汇总"), "L2", "OPERATIONAL_STAT", True, "L3", ("RULE_PII_BANK_CARD",)),
    ),
    (Composite("COMP_PII_001", ("name", "idcard|identity", "mobile|phone|cell"), "L5", "COMPOSITE_PII_COMBO", 3),),
)

_DISEASES = (
    "hiv", "aids", "std", "syphilis", "gonorrhea", "psychiatric", "schizophrenia", "depression", "mental", "cancer", "tumor", "oncology", "tuberculosis",
    "hepatitis", "艾滋病", "性病", "梅毒", "淋病", "精神病", "精神分裂", "抑抑症", "肿瘤", "癌症", "结核", "乙肝",
)

MEDICAL = Profile(
    "medical",
    (
        Rule("RULE_MED_G_001", "L5", "GENOMIC", 200, (_keywords(
            "brca1", "brca2", "tp53", "egfr", "kras", "braf", "alk", "pik3ca", "erbb2", "her2"),), "AND"),
        Rule("RULE_MED_G_002", "L5", "GENOMIC", 200, (_keywords(
            "snp", "cnv", "indel", "sv", "mutation", "variant", "genome", "genomic", "dna", "rna", "sequencing", "chromosome", "基因组", "变异", "突变", "单核苷酸多态性"), _regex(r"^rs\d+$")), "OR"),
        Rule("RULE_MED_G_003", "L5", "GENOMIC", 200, (_keywords("bam", "vcf", "fastq", "fasta", "cram", "bed", "gff", "gtf", use_word_boundaries=True),), "AND"),
        Rule("RULE_MED_DISEASE_001", "L4", "MEDICAL_TREATMENT", 150, (_keywords(*_DISEASES),), "AND"),
        Rule("RULE_MED_DISEASE_VALUE_001", "L4", "MEDICAL_TREATMENT", 160, (Matcher("keyword_contains", {"keywords": (*_DISEASES, "癌", "恶性肿瘤")}),), "AND"),
        Rule("RULE_MED_DISEASE_VALUE_002", "L5", "MEDICAL_TREATMENT", 170, (Matcher("keyword_contains", {"keywords": (
            "梅毒", "艾滋", "艾滋病", "hiv", "aids", "淋病", "尖锐湿疣", "精神分裂", "syphilis", "gonorrhea", "schizophrenia")}),), "AND"),
        Rule("RULE_MED_ICD10", "L3", "MEDICAL_TREATMENT", 120, (Matcher("icd10_range", {"default_level": "L3", "upgrade_level": "L4", "intervals": (
            {"start": "B20", "end": "B24"}, {"start": "A50", "end": "A53"}, {"start": "A54", "end": "A64"}, {"start": "F20", "end": "F29"}, {"start": "C00", "end": "C97"})}),), "AND"),
        Rule("RULE_MED_FILE_BAM", "L5", "GENOMIC", 180, (Matcher("prefix_match", {"prefixes": ("BAM\u0001", "@SQ")}),), "AND"),
        Rule("RULE_MED_FILE_VCF", "L5", "GENOMIC", 180, (Matcher("prefix_match", {"prefixes": ("##fileformat=VCF",)}),), "AND"),
        Rule("RULE_MED_SEQ", "L5", "GENOMIC", 180, (_regex("[ATCGNatcgn]{50,}"),), "AND"),
    ),
    (
        Downgrade("medical:RULE_DOWN_PUBLIC", ("public_report", "annual_summary", "科普", "公开", "宣传", "健康宣教", "medical_knowledge"), "L1", "PUBLIC_REPORT", False, ""),
        Downgrade("medical:RULE_DOWN_OPS", (
            "turnover_rate", "device_usage", "inventory", "hospital_stat", "bed_occupancy", "stat_count",
            "门诊量", "住院人次", "设备利用率", "床位周转率", "库存统计", "工作量"), "L2", "OPERATIONAL_STAT", True, "L3", ("RULE_PII_BANK_CARD",)),
    ),
    (Composite("COMP_MED_001", ("diagnosis", "disease", "illness", "gene", "genomic", "mutation", "brca", "tp53"), "L5", "COMPOSITE_MEDICAL_GENOMIC", 2),),
)

FINANCE = Profile(
    "finance",
    (
        Rule("RULE_FIN_ACCOUNT", "C4", "FINANCIAL_ACCOUNT", 100, (_keywords(
            "bankcard", "cardno", "card_no", "credit", "transaction", "asset", "balance", "account", "account_no", "acc_no", "bank_card", "bank_account", "iban",
            "swift", "passbook", "银行卡", "卡号", "账号", "资产", "余额", "账户", "银行账号", "存折"),), "AND"),
        Rule("RULE_FIN_CARD_VALUE", "C4", "FINANCIAL_ACCOUNT", 100, (Matcher("luhn_checksum", {"min_length": 16, "max_length": 19}),), "AND"),
        Rule("RULE_FIN_TRANSACTION", "C3", "FINANCIAL_TRANSACTION", 80, (_keywords(
            "transfer", "payment", "pay", "withdraw", "deposit", "loan", "remittance", "billing", "invoice", "order_amt", "trans_amt", "trans_amount", "pay_amt",
            "转账", "支付", "取款", "存款", "贷款", "汇款", "交易金额", "账单", "扣款", "充值"),), "AND"),
        Rule("RULE_FIN_PERSONAL", "C3", "PERSONAL_FINANCIAL", 60, (_keywords(
            "income", "salary", "wage", "paycheck", "tax", "insurance", "fund", "provident_fund", "pension", "revenue", "bonus", "收入", "工资", "薪资", "税额", "纳税",
            "保险", "社保", "公积金", "养老金", "奖金", "理财"),), "AND"),
    ),
    (Downgrade("RULE_FIN_DOWN_STAT", (
        "fin_stat_summary", "financial_stat", "stat_summary", "annual_report", "fin_report", "stat_cnt", "财务汇总", "金融统计", "统计月报", "报表", "汇总"), "C2", "FINANCIAL_OPERATIONAL_STAT", False, ""),),
    (Composite("COMP_FIN_001", ("bankcard|cardno|account|credit|transaction",), "C4", "COMPOSITE_FINANCE_COMBO", 2),),
)

GD_HEALTH = Profile(
    "gd_health",
    (
        Rule("RULE_GD_HEALTH_IDCARD", "G4", "PERSONAL_ATTRIBUTE", 95, (Matcher("id_card_checksum"), _keywords(
            "idcard", "sfz", "identity", "id_card", "身份证", "工作证", "居住证", "社保卡", "健康卡号", "住院号"))),
        Rule("RULE_GD_HEALTH_PHONE", "G4", "PERSONAL_ATTRIBUTE", 90, (_regex(MOBILE), _keywords("mobile", "phone", "cell", "telephone", "电话", "手机", "联系方式"))),
        Rule("RULE_GD_HEALTH_EMAIL", "G4", "PERSONAL_ATTRIBUTE", 85, (Matcher("email"), _keywords("email", "mail", "邮箱", "账号"))),
        Rule("RULE_GD_HEALTH_BIOMETRIC", "G4", "PERSONAL_ATTRIBUTE", 92, (_keywords(
            "gene", "fingerprint", "voiceprint", "palm", "iris", "基因", "指纹", "声纹", "掌纹", "耳廓", "虹膜", "面部特征", "生物识别"),)),
        Rule("RULE_GD_HEALTH_CREDIT", "G4", "PERSONAL_ATTRIBUTE", 80, (_keywords("credit", "信用", "征信", "信用评分", "信用报告"),)),
        Rule("RULE_GD_HEALTH_MEDICAL_RECORD", "G4", "PERSONAL_HEALTH", 88, (_keywords(
            "medical_record", "病历", "主诉", "chief_complaint", "现病史", "既往史", "家族史", "过敏史", "allergy", "体格检查", "遗传咨询"),)),
        Rule("RULE_GD_HEALTH_OUTPATIENT", "G4", "MEDICAL_APPLICATION", 86, (_keywords("outpatient", "门诊", "急诊", "就诊记录", "入院记录", "出院小结", "转诊"),)),
        Rule("RULE_GD_HEALTH_INSURANCE", "G4", "MEDICAL_FINANCE", 84, (_keywords("insurance", "保险", "保险账号", "保险状态", "保险金额", "医保"),)),
        Rule("RULE_GD_HEALTH_LAB_REPORT", "G3", "MEDICAL_APPLICATION", 70, (_keywords("lab_report", "test_report", "检验", "检查报告", "化验", "检验结果"),)),
        Rule("RULE_GD_HEALTH_SURGERY", "G3", "MEDICAL_APPLICATION", 68, (_keywords("surgery", "operation", "手术", "麻醉记录", "输血记录"),)),
        Rule("RULE_GD_HEALTH_MEDICAL_ORDER", "G3", "MEDICAL_APPLICATION", 66, (_keywords("medical_order", "医嘱", "病程记录", "progress_note", "护理记录"),)),
        Rule("RULE_GD_HEALTH_PAYMENT", "G3", "MEDICAL_FINANCE", 64, (_keywords("transaction", "payment", "交易", "支付信息", "消费金额", "交易记录", "费用"),)),
        Rule("RULE_GD_HEALTH_BANKCARD", "G3", "MEDICAL_FINANCE", 62, (Matcher("luhn_checksum"), _keywords("bank_card", "bankcard", "card_no", "银行卡", "卡号"))),
        Rule("RULE_GD_HEALTH_HOSPITAL_OPS", "G3", "HEALTH_RESOURCE", 50, (_keywords("hospital_operation", "运营数据", "人力资源", "财务数据", "物资数据", "后勤数据"),)),
        Rule("RULE_GD_HEALTH_MEDICATION", "G2", "MEDICAL_APPLICATION", 40, (_keywords("medication", "drug", "prescription", "用药", "药物", "处方", "药物剂量"),)),
        Rule("RULE_GD_HEALTH_HOSPITAL_BASIC", "G1", "HEALTH_RESOURCE", 30, (_keywords("hospital_name", "医疗机构名称", "医院学科", "床位数", "医院地址", "医疗机构类别"),)),
        Rule("RULE_GD_HEALTH_PUBLIC_HEALTH", "G1", "PUBLIC_HEALTH", 28, (_keywords("epidemic", "传染病", "疫情", "发病率", "死亡率", "疾病监测", "疫苗接种", "出生人数"),)),
    ),
    (),
    (Composite("COMP_GD_001", ("idcard|id_card|sfz|身份证", "mobile|phone|手机|电话", "病历|medical_record|诊断|diagnosis"), "G4", "PERSONAL_ATTRIBUTE", 3),),
)

SC_HEALTH = Profile(
    "sc_health_db51",
    (
        Rule("RULE_SC_HEALTH_DB51_IDCARD", "L3", "PERSONAL_BASIC", 90, (Matcher("id_card_checksum"), _keywords("idcard", "sfz", "identity", "id_card", "身份证"))),
        Rule("RULE_SC_HEALTH_DB51_PHONE", "L3", "PERSONAL_BASIC", 80, (_regex(MOBILE), _keywords("mobile", "phone", "cell", "电话", "手机"))),
        Rule("RULE_SC_HEALTH_DB51_BANKCARD", "L3", "FINANCIAL_ACCOUNT", 85, (Matcher("luhn_checksum", {"min_length": 13, "max_length": 19}), _keywords("bankcard", "cardno", "card_no", "bank_card", "支付卡号"))),
        Rule("RULE_SC_HEALTH_DB51_DISEASE", "L4", "MEDICAL_TREATMENT", 95, (_keywords("hiv", "aids", "std", "syphilis", "psychiatric", "schizophrenia", "艾滋病", "性病", "精神病"),), "AND"),
        Rule("RULE_SC_HEALTH_DB51_GENOMIC", "L5", "GENOMIC", 100, (_keywords(
            "gene", "genomic", "brca", "tp53", "snp", "cnv", "chromosome", "thalassemia", "基因", "染色体", "地中海贫血"),), "AND"),
    ),
    (Downgrade("DOWN_SC_HEALTH_DB51_OPS", ("turnover", "inventory", "device_usage", "开机次数", "门诊人次", "运行时间"), "L2", "MANAGEMENT", False, ""),),
)

#: Used only if neither default pack is there.
FALLBACK = Profile(
    "default",
    (
        Rule("id-card", "L4", "identity", 100, (_regex(r"^\d{17}[\dXx]$"), Matcher("id_card_checksum")), "AND"),
        Rule("mobile-phone", "L3", "contact", 90, (_regex(MOBILE),)),
        Rule("email", "L3", "contact", 80, (_regex(r"^[\w.+-]+@[\w-]+\.[\w.]+$"),)),
        Rule("bank-card", "L4", "financial", 95, (_regex(r"^\d{16,19}$"), Matcher("luhn_checksum")), "AND"),
        Rule("field-name-id", "L4", "identity", 70, (_keywords("id_card", "idcard", "身份证", "sfz", fields=("name",)),)),
        Rule("field-name-phone", "L3", "contact", 60, (_keywords("phone", "mobile", "手机", "电话", fields=("name",)),)),
    ),
)

PROFILES = {p.domain: p for p in (GENERAL_PII, MEDICAL, FINANCE, GD_HEALTH, SC_HEALTH)}
STANDARDS = {s.id: s for s in (Standard("gd_health", "gd_health", ("gd_health",)), Standard("jrt0197", "finance_jrt0197", ("general-pii", "finance")), Standard("sc_health_db51", "sc_health_db51", ("sc_health_db51",)))}

_L = {"L1": 1, "L2": 2, "L3": 3, "L4": 4, "L5": 5}
BUILT_IN = Taxonomy("built-in", "L1", _L, {"personal-info": "general/personal-info", "contact": "general/contact", "identity": "general/identity", "financial": "finance/financial", "medical": "health/medical"})
# What the levels of the taxonomies are called.
LEVEL_NAMES = {
    "default": {"L1": "公开数据", "L2": "内部数据", "L3": "敏感数据", "L4": "高敏感数据", "L5": "极敏感数据"},
    "finance_jrt0197": {"C1": "第一级（不敏感）", "C2": "第二级（低敏感）", "C3": "第三级（敏感）", "C4": "第四级（高敏感）"},
    "gd_health": {"G1": "第1级（低敏感）", "G2": "第2级（较低敏感）", "G3": "第3级（敏感）", "G4": "第4级（高敏感）"},
    "sc_health_db51": {"L1": "公开数据/第1级", "L2": "内部数据/第2级", "L3": "敏感数据/第3级", "L4": "高敏感数据/第4级", "L5": "极敏感数据/第5级"},
}
TAXONOMIES = {t.name: replace(t, names=LEVEL_NAMES[t.name]) for t in (
    Taxonomy("default", "L3", _L, {c: f"MEDICAL_TREATMENT/{c}" for c in ("GENOMIC", "MEDICAL_ICD10_GENERAL", "MEDICAL_ICD10_HIV", "MEDICAL_ICD10_STD", "MEDICAL_ICD10_PSYCHIATRIC", "MEDICAL_ICD10_CANCER")}),
    Taxonomy("finance_jrt0197", "C3", {"C1": 1, "C2": 2, "C3": 3, "C4": 4}),
    Taxonomy("gd_health", "G2", {"G1": 1, "G2": 2, "G3": 3, "G4": 4}),
    Taxonomy("sc_health_db51", "L3", _L),
)}
