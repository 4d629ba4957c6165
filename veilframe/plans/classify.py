"""Dynamic classification: rule packs compiled to columns.

A pack becomes one expression a field: an array of tags in rule order (priority falling, then pack
order), which decides ties. Suppression, conflicts and the final level are expressions over that array.
Nothing here runs a Python function on a row; named-entity and model layers are optional callables that
see only the rows the rule layer leaves open.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.text import let, normalised, normalised_text
from veilframe.plans import matchers, packs
from veilframe.plans.budget import PrivacyError
from veilframe.plans.matchers import Field
from veilframe.plans.model import Composite, Downgrade, Policy, Profile, Rule, Standard, Taxonomy

TAG = "struct<level:string,category:string,source:string,confidence:double,rule_id:string>"
LAYER_RULE, LAYER_NER, LAYER_LLM = "rule", "ner", "llm"
Bound = Column | dict[str, Column]


def normal_forms(name: Column, value: Column) -> list[Column]:
    """(name, value, plain_name, plain_value): a field and its normal forms."""
    text = value.cast("string")
    return [name.alias("name"), text.alias("value"), normalised(name).alias("plain_name"), normalised(text).alias("plain_value")]


def _tag(level: str, category: str, source: str, confidence: float, rule: str) -> Column:
    return F.struct(F.lit(level).alias("level"), F.lit(category).alias("category"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"), F.lit(rule).alias("rule_id"))


@dataclass(frozen=True)
class Classifier:
    taxonomy: Taxonomy
    rules: tuple[Rule, ...]
    downgrades: tuple[Downgrade, ...]
    composites: tuple[Composite, ...]
    policy: Policy = Policy()
    semantics: str = "reference"

    # -- rules -------------------------------------------------------------------------------------

    def bind(self, name: Column, value: Column) -> Column:
        """A field with its normal forms, to be evaluated once however many rules read it."""
        return F.struct(*normal_forms(name, value))

    def rule_hits(self, rule: Rule, name: Column, value: Column) -> Column:
        return self._hits(rule, self.bind(name, value))

    def _hits(self, rule: Rule, bound: Bound) -> Column:
        hits = []
        for m in rule.matchers:
            f = Field.bound(bound, self.semantics, m.target)
            operator = matchers.get(m.operator) or matchers.intended(f, m.operator)
            hits.append(operator(f, m.params) if operator else F.lit(False))
        if not hits:
            return F.lit(False)
        out = hits[0]
        for h in hits[1:]:
            out = (out & h) if rule.match_logic.upper() == "AND" else (out | h)
        return out

    def _tags(self, bound: Column) -> Column:
        """Array of the tags of all rules that hit, distinct, before suppression."""
        made = [
            F.when(self._hits(r, bound), _tag(r.level or self.taxonomy.default_level, r.category or "unknown", LAYER_RULE, self.policy.rule_confidence, r.id))
            for r in sorted((r for r in self.rules if r.enabled), key=lambda r: -r.priority)
        ]
        return F.array_distinct(F.array_compact(F.array(*made))) if made else F.array().cast(f"array<{TAG}>")

    def rank(self, level: Column) -> Column:
        out = F.lit(0)
        for name, rank in self.taxonomy.levels.items():
            out = F.when(level == name, rank).otherwise(out)
        return out

    def suppressible(self, d: Downgrade) -> list[str]:
        """The rules a downgrade may suppress: those that no exemption glob matches in full."""
        exempt = [re.compile(matchers.glob(p), re.DOTALL) for p in d.exempt_rules]
        return [r.id for r in self.rules if not any(e.fullmatch(r.id) for e in exempt)]

    def _suppressed(self, tags: Column, bound: Column) -> Column:
        """The tags that active downgrades take away: ranked above the cap, or with intended semantics
        at or below it."""
        gone = F.array().cast(f"array<{TAG}>")
        for d in self.downgrades:
            if not d.force_suppress:
                continue
            # Without a tag that it could take, a downgrade's keywords are not even looked for.
            takes = self._taken(self._cap(d), self.suppressible(d))
            gone = F.when(F.exists(tags, takes) & self._active(d, bound), F.array_union(gone, F.filter(tags, takes))).otherwise(gone)
        return gone

    def _active(self, d: Downgrade, bound: Bound) -> Column:
        """Whether a downgrade's keywords occur in a field's value or name."""
        if not d.keywords:
            return F.lit(True)
        words = [normalised_text(k) for k in d.keywords]
        return matchers.contains_any(bound["plain_value"], words) | matchers.contains_any(bound["plain_name"], words)

    def _cap(self, d: Downgrade) -> int:
        return 2**31 - 1 if d.max_force_suppress_level is None else self.taxonomy.rank(d.max_force_suppress_level)

    def _taken(self, cap: int, free: list[str]) -> Callable[[Column], Column]:
        def taken(t: Column) -> Column:
            over = self.rank(t["level"]) <= cap if self.semantics == "intended" else self.rank(t["level"]) > cap
            return over & t["rule_id"].isin(free)

        return taken

    def kept_tags(self, name: Column, value: Column) -> Column:
        """The tags that hit and are not suppressed."""
        return let(self.bind(name, value), lambda b: let(self._tags(b), lambda t: F.array_except(t, self._suppressed(t, b))))

    def keeps_any(self, bound: Bound) -> Column:
        """Whether ``kept_tags`` of a bound field has any: the first rule that hits and is not suppressed settles it,
        and no tag is made."""

        def kept(r: Rule) -> Column:
            out, rank = self._hits(r, bound), self.taxonomy.rank(r.level or self.taxonomy.default_level)
            for d in self.downgrades:
                taken = rank <= self._cap(d) if self.semantics == "intended" else rank > self._cap(d)
                if d.force_suppress and taken and r.id in self.suppressible(d):
                    out = out & ~self._active(d, bound)
            return out

        return F.coalesce(functools.reduce(Column.__or__, (kept(r) for r in self.rules if r.enabled), F.lit(False)), F.lit(False))

    # -- funnel ------------------------------------------------------------------------------------

    def max_level(self, tags: Column) -> Column:
        """The first of the highest-ranked levels; the default level of none."""
        start = F.struct(F.lit(None).cast("string").alias("level"), F.lit(-1).alias("rank"))
        best = F.aggregate(tags, start, lambda a, t: F.when(self.rank(t["level"]) > a["rank"], F.struct(t["level"].alias("level"), self.rank(t["level"]).alias("rank"))).otherwise(a))
        return F.coalesce(best["level"], F.lit(self.taxonomy.default_level))

    def conflict(self, tags: Column) -> Column:
        ranks = F.transform(tags, lambda t: self.rank(t["level"]))
        return F.coalesce((F.size(tags) > 1) & (F.array_max(ranks) - F.array_min(ranks) > 1), F.lit(False))

    def field(self, name: Column, value: Column) -> Column:
        """struct<tags, suppressed, final_level, confidence, engine_layer, conflict, needs_review, value>."""

        def result(b: Column, gone: Column, kept: Column) -> Column:
            shown = F.when(F.length(b["value"]) > 100, F.concat(F.substring(b["value"], 1, 100), F.lit("..."))).otherwise(b["value"])
            sure = self.policy.rule_confidence
            return F.struct(
                kept.alias("tags"), gone.alias("suppressed"), self.max_level(kept).alias("final_level"), F.lit(sure).alias("confidence"), F.lit(LAYER_RULE).alias("engine_layer"),
                self.conflict(kept).alias("conflict"), F.lit(sure < self.policy.review_below).alias("needs_review"), shown.alias("value"),
            )

        def tagged(b: Column) -> Column:
            return let(self._tags(b), lambda t: let(self._suppressed(t, b), lambda g: let(F.array_except(t, g), lambda k: result(b, g, k))))

        return let(self.bind(name, value), tagged)

    def ner_tags(self, entities: Column, mapping: dict[str, str]) -> Column:
        """Tags of an array<struct<text,label,score>> of entities; a mapping gives "level:category" or a
        category, and the level is L3 otherwise."""
        level, category = F.lit("L3"), F.lit(None).cast("string")

        def one(e: Column) -> Column:
            lv, cat = level, F.coalesce(category, e["label"])
            for label, to in mapping.items():
                a, _, b = to.rpartition(":")
                lv = F.when(e["label"] == label, F.lit(a or "L3")).otherwise(lv)
                cat = F.when(e["label"] == label, F.lit(b)).otherwise(cat)
            return F.struct(lv.alias("level"), cat.alias("category"), F.lit(LAYER_NER).alias("source"), e["score"].cast("double").alias("confidence"), F.concat(F.lit("ner:"), e["label"]).alias("rule_id"))

        return F.transform(entities, one)

    # -- records and tables ------------------------------------------------------------------------

    def composite_tags(self, names: list[str]) -> list[Composite]:
        """Composite rules met by a set of field names: decided when the plan is built."""
        low, out = [n.lower() for n in names], []
        for c in self.composites:
            hits = sum(any(matchers.found(rf"(?i)\b{p}\b", n) for n in low) for p in c.field_patterns if matchers.valid(rf"\b{p}\b"))
            if hits >= c.min_matches:
                out.append(c)
        return out

    def composite_level(self, names: list[str]) -> str | None:
        best, rank = None, 0
        for c in self.composite_tags(names):
            if self.taxonomy.rank(c.target_level) > rank:
                best, rank = c.target_level, self.taxonomy.rank(c.target_level)
        return best

    def long_form(self, df: DataFrame, record_id: str, columns: list[str] | None = None) -> DataFrame:
        """(record_id, field, value): one row a field, so that every rule is compiled once however wide
        the table is."""
        columns = columns or [c for c in df.columns if c != record_id]
        pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns))
        return df.select(F.col(record_id).alias("record_id"), F.inline(pairs))

    def classify_fields(self, df: DataFrame, record_id: str, columns: list[str] | None = None, llm: Callable[[DataFrame], DataFrame] | None = None, ner: Callable[[DataFrame], DataFrame] | None = None, ner_mapping: dict[str, str] | None = None) -> DataFrame:
        """(record_id, field, value, tags, suppressed, final_level, confidence, engine_layer, conflict,
        needs_review). Layers that the policy enables see (record_id, field, value) of the rows that the
        rules leave open: ``ner``, those without tags or in conflict, and returns (record_id, field,
        entities array<struct<text, label, score>>); ``llm``, those without tags, and returns (record_id,
        field, level)."""
        rows = self.long_form(df, record_id, columns)
        out = rows.select("record_id", "field", self.field(F.col("field"), F.col("value")).alias("r")).select("record_id", "field", "r.*")
        if ner is not None and self.policy.enable_ner:
            asked = rows.join(out.filter((F.size("tags") == 0) | F.col("conflict")).select("record_id", "field"), ["record_id", "field"], "left_semi")
            found = ner(asked).select("record_id", "field", self.ner_tags(F.col("entities"), ner_mapping or {}).alias("_more")).filter(F.size("_more") > 0)
            out = out.join(found, ["record_id", "field"], "left").withColumn("_seen", F.col("_more").isNotNull())
            out = out.withColumn("tags", F.when(F.col("_seen"), F.concat("tags", F.col("_more").cast(f"array<{TAG}>"))).otherwise(F.col("tags")))
            out = out.withColumn("final_level", F.when(F.col("_seen"), self.max_level(F.col("tags"))).otherwise(F.col("final_level"))).withColumn("engine_layer", F.when(F.col("_seen"), LAYER_NER).otherwise(F.col("engine_layer"))).drop("_more", "_seen")
        if llm is not None and self.policy.enable_llm and (self.policy.rule_confidence < self.policy.llm_below or self.semantics == "intended"):
            open_rows = rows.filter(F.size(self.kept_tags(F.col("field"), F.col("value"))) == 0)
            asked = llm(open_rows.select("record_id", "field", "value")).filter(F.col("level").isin(*self.taxonomy.levels))
            out = out.join(asked.select("record_id", "field", F.col("level").alias("_level")), ["record_id", "field"], "left")
            out = out.withColumn("final_level", F.coalesce("_level", "final_level")).withColumn("engine_layer", F.when(F.col("_level").isNotNull(), LAYER_LLM).otherwise(F.col("engine_layer"))).drop("_level")
        return out

    def record_tags(self, columns: list[str]) -> Column:
        """The kept tags of all fields of a row, in column order, by one compiled expression."""
        pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns))
        return F.flatten(F.transform(pairs, lambda p: self.kept_tags(p["field"], p["value"])))

    def record_level(self, tags: Column, composite: str | None) -> Column:
        own = self.max_level(tags)
        if composite is None:
            return own
        if self.semantics == "intended":
            return F.when(self.rank(own) > self.taxonomy.rank(composite), own).otherwise(F.lit(composite))
        return F.lit(composite)

    def classify_records(self, df: DataFrame, record_id: str, columns: list[str] | None = None) -> DataFrame:
        """(record_id, final_level, confidence, needs_review, n_tags, composites): fields rolled up.

        A composite level replaces the record's; with intended semantics it only raises it. The fields of
        a row are combined in the row, without a shuffle.
        """
        columns = columns or [c for c in df.columns if c != record_id]
        met = self.composite_tags(columns)
        level = self.composite_level(columns)
        rows = df.select(F.col(record_id).alias("record_id"), self.record_tags(columns).alias("tags"))
        own = self.record_level(F.col("tags"), level)
        return rows.select("record_id", own.alias("final_level"), F.lit(self.policy.rule_confidence).alias("confidence"), F.lit(False).alias("needs_review"), (F.size("tags") + len(met)).alias("n_tags"), F.array(*(F.lit(c.id) for c in met)).cast("array<string>").alias("composites"))

    def classify_table(self, df: DataFrame, record_id: str, columns: list[str] | None = None) -> DataFrame:
        """(records, final_level, confidence, needs_review, n_tags): one row. Of equal ranks the record
        that comes first by id decides."""
        r = self.classify_records(df, record_id, columns)
        best = F.max_by("final_level", F.struct(self.rank(F.col("final_level")), -F.col("record_id"))) if isinstance(r.schema["record_id"].dataType, T.NumericType) else F.max_by("final_level", self.rank(F.col("final_level")))
        return r.agg(F.count("*").alias("records"), F.coalesce(best, F.lit(self.taxonomy.default_level)).alias("final_level"), F.max("confidence").alias("confidence"), F.bool_or("needs_review").alias("needs_review"), F.sum("n_tags").alias("n_tags"))


def build(domain: str | None = None, standard: str | None = None, semantics: str = "reference", policy: Policy | None = None, profiles: dict[str, Profile] | None = None, standards: dict[str, Standard] | None = None, taxonomies: dict[str, Taxonomy] | None = None) -> Classifier:
    """The classifier of a standard, of a domain, or of the default packs.

    Reference semantics: a standard can't be loaded (its taxonomy does not parse), every other engine
    uses the built-in taxonomy, and without domain or standard there are no composite rules. Intended
    semantics: taxonomies load as written.
    """
    known = packs.PROFILES if profiles is None else profiles
    written = packs.TAXONOMIES if taxonomies is None else taxonomies
    for name in (domain, standard):
        if name and not re.fullmatch(r"[\w-]+", name):
            raise PrivacyError(f"not a name: {name!r}")
    composites: tuple[Composite, ...] = ()
    if standard:
        s = (packs.STANDARDS if standards is None else standards).get(standard)
        if s is None or semantics == "reference":
            raise PrivacyError(f"standard {standard!r} can't be loaded")
        chosen, taxonomy = [known[d] for d in s.domains], written[s.taxonomy]
        composites = tuple(c for p in chosen for c in p.composites)
    elif domain:
        if domain not in known:
            raise PrivacyError(f"no domain {domain!r}")
        chosen, taxonomy = [known[domain]], packs.BUILT_IN if semantics == "reference" else _taxonomy_for(known[domain], written)
        composites = known[domain].composites
    else:
        chosen = [known[d] for d in ("general-pii", "medical") if d in known] or [packs.FALLBACK]
        taxonomy = packs.BUILT_IN if semantics == "reference" else written.get("default", packs.BUILT_IN)
    rules = tuple(r for p in chosen for r in p.rules)
    return Classifier(taxonomy, rules, tuple(d for p in chosen for d in p.downgrades), composites, policy or Policy(), semantics)


def _taxonomy_for(profile: Profile, taxonomies: dict[str, Taxonomy]) -> Taxonomy:
    """The first taxonomy that knows all levels of a profile, the default one before the others."""
    levels = {r.level for r in profile.rules}
    order = sorted(taxonomies.values(), key=lambda t: (t.name != "default", t.name))
    return next((t for t in order if levels <= set(t.levels)), taxonomies.get("default", packs.BUILT_IN))


def arbitrate(taxonomy: Taxonomy, rule_level: str | None, model_level: str | None) -> str | None:
    """The level of higher rank; the rules' if equal or if the model gave none that the taxonomy knows."""
    if model_level not in taxonomy.levels:
        return rule_level
    return model_level if taxonomy.rank(model_level) > taxonomy.rank(rule_level) else rule_level


def audited(result: DataFrame) -> DataFrame:
    """A classification result with the time it was made, ``audit_timestamp``."""
    return result.withColumn("audit_timestamp", F.current_timestamp())


def coverage(rows: DataFrame, domains: list[str] | None = None, semantics: str = "reference") -> DataFrame:
    """(domain, rules, fields, tagged) for each rule pack: its rules, and how many of the (field, value) rows there are and
    get a tag from it. All packs are judged in one pass over ``rows``, from one pair of normal forms.

    The judgement is a projection of its own over plain columns. As the packs' checksums are higher-order functions, it is
    compiled apart from its stage, in small methods; one method of all keywords would be too large for the JVM to compile.
    """
    packs_ = {d: build(d, semantics=semantics) for d in domains or list_domains()}
    bound = rows.select(*normal_forms(F.col("field"), F.col("value")))
    judged = bound.select(F.array(*(c.keeps_any({n: F.col(n) for n in bound.columns}) for c in packs_.values())).alias("_kept"))
    tagged = [F.count_if(F.get("_kept", F.lit(i))).alias(f"t{i}") for i in range(len(packs_))]
    told = [F.struct(F.lit(d).alias("domain"), F.lit(len([r for r in c.rules if r.enabled])).cast("long").alias("rules"), F.col("fields"), F.col(f"t{i}").alias("tagged")) for i, (d, c) in enumerate(packs_.items())]
    return judged.agg(F.count(F.lit(1)).alias("fields"), *tagged).select(F.inline(F.array(*told)))


def list_standards() -> list[str]:
    return sorted(packs.STANDARDS)


def list_domains() -> list[str]:
    return sorted(packs.PROFILES)


def list_operators() -> list[str]:
    return matchers.names()


def dry_run(name: str, value: str | None, spark, **options) -> dict:
    """Classify one field and return a plain dictionary."""
    c = build(**options)
    row = spark.createDataFrame([(name, value)], "n string, v string").select(c.field(F.col("n"), F.col("v")).alias("r")).first()
    return row["r"].asDict(recursive=True)
