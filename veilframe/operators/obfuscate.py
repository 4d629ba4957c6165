"""Query obfuscation: the real query among dummies of the same shape or of similar length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.text import let
from veilframe.plans.budget import PrivacyError

# Dummy queries and slot terms.
MEDICAL_QUERIES = (
    "高血压患者的日常饮食建议", "糖尿病患者运动注意事项", "冠心病的早期症状有哪些", "流感疫苗接种人群建议", "儿童常见过敏反应处理",
    "胃溃疡患者吃什么食物好", "哮喘发作时的紧急处理方法", "慢性支气管炎的预防措施", "抑郁症自我调理与心理疏导", "长期失眠的危害及改善建议",
    "脂肪肝患者运动处方", "痛风患者避免食用的食物清单", "过敏性鼻炎的日常防治手段", "颈椎病康复训练操指南", "偏头痛的诱发因素与缓解方式",
    "脑梗塞前兆表现及预防建议", "骨质疏松防摔倒安全提示", "带状疱疹的临床表现及治疗", "过敏性皮炎日常注意事项", "甲状腺结节患者饮食禁忌",
)
GENERIC_QUERIES = (
    "天气预报查询", "附近医院挂号流程", "健康档案如何查询", "医保报销比例说明", "体检报告解读指南",
    "公积金提取线上办理步骤", "个人所得税申报操作引导", "社保卡丢失如何在线补办", "市民卡网点营业时间查询", "生活垃圾分类最新标准",
    "最近的公共图书馆开放时间", "电动自行车上牌申领流程", "常用快递运费价格对比", "附近免费公共停车场推荐", "燃气费线上缴费使用指南",
    "自来水水质检测结果公告", "本地博物馆门票预约入口", "公交线路首末班车时间查询", "居住证积分申请材料清单", "数字证书在线更新流程",
)
DISEASES = ("高血压", "糖尿病", "冠心病", "流感", "胃溃疡", "哮喘", "脑梗塞", "痛风", "失眠", "抑郁症", "脂肪肝", "肺炎", "甲状腺结节", "过敏性鼻炎", "颈椎病")
ENTITIES = ("社保卡", "医保", "公积金", "健康档案", "体检报告", "居住证", "天气预报", "市民卡", "数字证书", "身份证")


def _shuffled(items: Column, query: Column, seed: str | None) -> Column:
    """A random order, or with ``seed`` the order of md5(seed|query|item)."""
    if seed is None:
        return F.shuffle(items)
    keyed = F.transform(items, lambda x: F.struct(F.md5(F.concat_ws("|", F.lit(seed), query, x).cast("binary")).alias("h"), x.alias("x")))
    return F.sort_array(keyed)["x"]  # by the fields' own order; array_sort would run a comparator of expressions


def obfuscate(query: Column | str, dummies: int = 3, domain: str | None = "medical", medical_pool: list[str] | None = None, generic_pool: list[str] | None = None, seed: str | None = None) -> Column:
    """struct<queries, real_index, domain, num_dummies, strategy> for a query column.

    With a built-in pool, a query that holds one of the domain's terms is copied with other terms in its
    place; else dummies are taken from the pool, near the query's length if any are. ``seed`` makes
    the choice a function of the query, for tests.
    """
    if dummies < 0:
        raise PrivacyError(f"the number of dummies is negative: {dummies}")
    query = F.col(query) if isinstance(query, str) else query
    medical = (domain or "").lower() == "medical"
    own_pool = medical_pool if medical else generic_pool
    pool = list(own_pool or (MEDICAL_QUERIES if medical else GENERIC_QUERIES))
    terms = () if own_pool else (DISEASES if medical else ENTITIES)

    none, items = F.array().cast("array<string>"), F.array(*map(F.lit, pool))

    def slots(first: Column) -> Column:
        others = F.slice(_shuffled(F.array_remove(known, first), query, seed), 1, dummies) if dummies else none
        return F.when(first.isNotNull(), F.transform(others, lambda o: F.replace(query, first, o)))

    def similar(others: Column) -> Column:
        near = lambda among, d: let(F.length(query), lambda n: F.filter(among, lambda x: F.abs(F.length(x) - n) <= d))
        close = let(near(others, 12), lambda wide: let(near(wide, 6), lambda tight: F.when(F.size(tight) > 0, tight).when(F.size(wide) > 0, wide).otherwise(others)))
        # Beyond the pool's size, items repeat.
        return let(_shuffled(close, query, seed), lambda order: F.slice(F.flatten(F.array_repeat(order, F.ceil(F.lit(dummies) / F.size(order)).cast("int"))), 1, dummies))

    by_length = let(F.filter(items, lambda x: x != query), lambda others: similar(F.when(F.size(others) == 0, items).otherwise(others))) if dummies else none
    if len(terms) - 1 >= dummies and terms:
        known = F.array(*map(F.lit, terms))
        filled = let(F.get(F.filter(known, lambda t: F.contains(query, t)), F.lit(0)), slots)  # the first term of the list wins
    else:
        filled = F.lit(None).cast("array<string>")
    at = F.floor(F.rand() * (dummies + 1)).cast("int") if seed is None else F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), query).cast("binary")), 1, 7), 16, 10).cast("long"), F.lit(dummies + 1)).cast("int")

    def result(found: Column) -> Column:
        fakes, place = F.coalesce(found["filled"], by_length), found["at"]
        return F.struct(F.array_insert(fakes, place + 1, query).alias("queries"), place.alias("real_index"), F.lit((domain or "").lower()).alias("domain"), F.lit(dummies).alias("num_dummies"), F.when(found["filled"].isNotNull(), "slot_filling").otherwise("length_similarity").alias("strategy"))

    return let(F.struct(filled.alias("filled"), at.alias("at")), result)


def obfuscate_batch(df: DataFrame, column: str, **options) -> DataFrame:
    """One row a query sent: the rows of ``df`` times (position, query, is_real). The array of these is made as a
    whole, as fields of the struct taken one by one would each obfuscate the query anew."""
    sent = let(obfuscate(column, **options), lambda o: F.transform(o["queries"], lambda q, i: F.struct(i.alias("position"), q.alias("query"), (i == o["real_index"]).alias("is_real"))))
    return df.select(*df.columns, F.inline(sent))
