"""Rule packs, taxonomies and standards kept in files.

A folder holds ``domains/``, ``taxonomies/`` and ``standards/``, a file for each name: JSON, or YAML where
PyYAML is installed. Keys are those of ``as_document``; unknown keys are ignored. Classifiers are compiled
from what a file held when it was first read; ``reload`` forgets that.
"""

from __future__ import annotations

import hashlib
import json
import threading
from pathlib import Path

from veilframe.plans import classify, packs
from veilframe.plans.budget import PrivacyError
from veilframe.plans.classify import Classifier
from veilframe.plans.model import Composite, Downgrade, Matcher, Policy, Profile, Rule, Standard, Taxonomy

SUFFIXES = (".json", ".yaml", ".yml")


def read_document(path: Path) -> dict:
    """A JSON or YAML file that holds an object."""
    if path.suffix == ".json":
        found = json.loads(path.read_text(encoding="utf-8"))
    else:
        try:
            import yaml
        except ImportError as e:
            raise PrivacyError("YAML files need PyYAML; use JSON") from e
        found = yaml.safe_load(path.read_text(encoding="utf-8"))
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise PrivacyError(f"{path.name} holds no object")
    return found


def _frozen(value):
    return tuple(_frozen(v) for v in value) if isinstance(value, list) else {k: _frozen(v) for k, v in value.items()} if isinstance(value, dict) else value


def profile_of(doc: dict) -> Profile:
    rules = tuple(
        Rule(
            str(r["id"]), r.get("level"), r.get("category"), int(r.get("priority", 50)),
            tuple(Matcher(str(m.get("operator")), _frozen(m.get("params") or {}), str(m.get("target") or "field_value")) for m in r.get("matchers") or ()),
            str(r.get("match_logic") or "OR"), bool(r.get("enabled", True)),
        )
        for r in doc.get("rules") or ()
    )
    downgrades = tuple(
        Downgrade(str(d["id"]), tuple(map(str, d.get("keywords") or ())), d.get("level") or "", d.get("category") or "", bool(d.get("force_suppress", False)), d.get("max_force_suppress_level"), tuple(map(str, d.get("exempt_rules") or ())))
        for d in doc.get("downgrade_rules") or ()
    )
    composites = tuple(Composite(str(c["id"]), tuple(map(str, c.get("field_patterns") or ())), c.get("target_level") or "", c.get("category") or "", int(c.get("min_matches", 2))) for c in doc.get("composite_rules") or ())
    return Profile(str(doc.get("domain", "")), rules, downgrades, composites)


def taxonomy_of(name: str, doc: dict) -> Taxonomy:
    """Levels and categories may be lists of objects with an id, or objects by id."""

    def by_id(found) -> dict[str, dict]:
        return {str(x["id"]): x for x in found} if isinstance(found, list) else {str(k): v or {} for k, v in (found or {}).items()}

    levels = {k: int(v.get("rank", 0)) for k, v in by_id(doc.get("levels")).items()}
    names = {k: str(v["name"]) for k, v in by_id(doc.get("levels")).items() if v.get("name")}
    categories = {k: str(v.get("path") or k) for k, v in by_id(doc.get("categories")).items()}
    return Taxonomy(name, str(doc.get("default_level") or "L3"), levels, categories, names)


def as_document(x: Profile | Taxonomy | Standard) -> dict:
    """What a file holds for a profile, taxonomy or standard."""
    if isinstance(x, Profile):
        return {
            "domain": x.domain,
            "rules": [{"id": r.id, "level": r.level, "category": r.category, "priority": r.priority, "match_logic": r.match_logic, "enabled": r.enabled, "matchers": [{"target": m.target, "operator": m.operator, "params": m.params} for m in r.matchers]} for r in x.rules],
            "downgrade_rules": [{"id": d.id, "keywords": d.keywords, "level": d.level, "category": d.category, "force_suppress": d.force_suppress, "max_force_suppress_level": d.max_force_suppress_level, "exempt_rules": d.exempt_rules} for d in x.downgrades],
            "composite_rules": [{"id": c.id, "field_patterns": c.field_patterns, "target_level": c.target_level, "category": c.category, "min_matches": c.min_matches} for c in x.composites],
        }
    if isinstance(x, Taxonomy):
        return {"domain": x.name, "default_level": x.default_level, "levels": {k: {"id": k, "rank": r} | ({"name": x.names[k]} if k in x.names else {}) for k, r in x.levels.items()}, "categories": {k: {"id": k, "path": p} for k, p in x.categories.items()}}
    return {"standard_id": x.id, "taxonomy": x.taxonomy, "domains": x.domains}


KINDS = ("domains", "taxonomies", "standards")


class RuleStore:
    """A folder of rule files; what is read is kept until ``reload``."""

    def __init__(self, folder: str, semantics: str = "reference", policy: Policy | None = None):
        self.folder, self.semantics, self.policy = Path(folder), semantics, policy
        self._read: dict[tuple[str, str], object] = {}
        self._lock = threading.Lock()

    def _path(self, kind: str, name: str) -> Path:
        if not name or ".." in name or "/" in name or "\\" in name:
            raise PrivacyError(f"not a name: {name!r}")
        root = self.folder.resolve()
        for suffix in SUFFIXES:
            path = (self.folder / kind / (name + suffix)).resolve()
            if not path.is_relative_to(root):
                raise PrivacyError(f"{name!r} leads out of the folder")
            if path.is_file():
                return path
        raise PrivacyError(f"no {name!r} among {kind}")

    def _document(self, kind: str, name: str) -> dict:
        return read_document(self._path(kind, name))

    def _get(self, kind: str, name: str, make):
        with self._lock:
            if (kind, name) not in self._read:
                self._read[kind, name] = make(self._document(kind, name))
            return self._read[kind, name]

    def profile(self, name: str) -> Profile:
        return self._get("domains", name, profile_of)

    def taxonomy(self, name: str) -> Taxonomy:
        return self._get("taxonomies", name, lambda d: taxonomy_of(name, d))

    def standard(self, name: str) -> Standard:
        return self._get("standards", name, lambda d: Standard(str(d.get("standard_id") or name), str(d.get("taxonomy") or "default"), tuple(map(str, d.get("domains") or ()))))

    def names(self, kind: str) -> list[str]:
        """The names that files of a kind (domains, taxonomies, standards) give."""
        return sorted({p.stem for p in (self.folder / kind).glob("*") if p.suffix in SUFFIXES})

    def reload(self) -> None:
        with self._lock:
            self._read.clear()

    def frozen(self) -> FrozenStore:
        """All rules as the files have them now, apart from what becomes of the files."""
        return FrozenStore({kind: {n: read_document(self._path(kind, n)) for n in self.names(kind)} for kind in KINDS}, self.semantics, self.policy)

    def classifier(self, domain: str | None = None, standard: str | None = None) -> Classifier:
        """As ``classify.build``, from the folder's files."""
        standards = {standard: self.standard(standard)} if standard else {}
        wanted = standards[standard].domains if standard else (domain,) if domain else [n for n in ("general-pii", "medical") if n in self.names("domains")]
        profiles = {n: self.profile(n) for n in wanted}
        taxonomies = {n: self.taxonomy(n) for n in self.names("taxonomies")} if self.semantics == "intended" else {}
        return classify.build(domain, standard, self.semantics, self.policy, profiles, standards, taxonomies)

    def write(self, *documents: Profile | Taxonomy | Standard) -> None:
        """Keep rule packs as JSON files."""
        for x in documents:
            kind, name = ("domains", x.domain) if isinstance(x, Profile) else ("taxonomies", x.name) if isinstance(x, Taxonomy) else ("standards", x.id)
            if not name or ".." in name or "/" in name or "\\" in name:
                raise PrivacyError(f"not a name: {name!r}")
            path = self.folder / kind / f"{name}.json"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(json.dumps(as_document(x), ensure_ascii=False, indent=1), encoding="utf-8")
        self.reload()


class FrozenStore(RuleStore):
    """Rules by their documents, {kind: {name: document}}, named by a digest of what they say."""

    def __init__(self, documents: dict[str, dict[str, dict]], semantics: str = "reference", policy: Policy | None = None):
        super().__init__("", semantics, policy)
        self.documents = documents
        said = json.dumps([documents, semantics, repr(policy)], sort_keys=True, ensure_ascii=False)
        self.version = hashlib.sha256(said.encode()).hexdigest()[:16]

    def _document(self, kind: str, name: str) -> dict:
        try:
            return self.documents[kind][name]
        except KeyError:
            raise PrivacyError(f"no {name!r} among {kind}") from None

    def names(self, kind: str) -> list[str]:
        return sorted(self.documents.get(kind, {}))

    def frozen(self) -> FrozenStore:
        return self

    def write(self, *documents: Profile | Taxonomy | Standard) -> None:
        raise PrivacyError("frozen rules can't be changed")


def write_bundled(folder: str) -> RuleStore:
    """A folder with the bundled packs, to start one's own from."""
    store = RuleStore(folder)
    store.write(*packs.PROFILES.values(), *packs.TAXONOMIES.values(), *packs.STANDARDS.values())
    return store
