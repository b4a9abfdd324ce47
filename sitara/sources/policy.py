"""The masking policy: entities, previews, replacements and the gazetteer.

A policy is small and lives on the driver; ``entities`` gives it as rows for
joins. ``load`` reads it from a folder of JSON (or YAML, if PyYAML is there)
files, ``overlay`` merges a table of custom entities over it.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitara.functions.text import GAZETTEER, fold_text

ACTIONS = ("MASK", "BLOCK", "ALLOW")
CATEGORIES = ("id", "contact", "finance", "person", "location", "other")
STRATEGIES = ("placeholder", "redact", "constant", "labelled_fingerprint", "surrogate")
ENTITY_NAME = re.compile(r"^[A-Z][A-Z0-9_]{1,63}$")


class PolicyError(ValueError):
    """A policy that contradicts itself or misses a value."""


@dataclass(frozen=True)
class Preview:
    """How much of a value an auditor sees: ``none``, ``first_last`` or ``last``."""

    mode: str = "none"
    first: int = 0
    last: int = 0

    def __post_init__(self) -> None:
        if self.mode not in ("none", "first_last", "last") or not (0 <= self.first <= 8 and 0 <= self.last <= 8):
            raise PolicyError(f"bad preview {self}")


@dataclass(frozen=True)
class Replacement:
    """What stands for a masked value."""

    strategy: str = "placeholder"
    value: str | None = None
    pool: tuple[str, ...] = ()
    fingerprint_chars: int = 8

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise PolicyError(f"unknown strategy {self.strategy}")
        if (self.strategy == "constant") != bool(self.value and self.value.strip()):
            raise PolicyError("a constant, and nothing else, has a value")
        if (self.strategy == "surrogate") != bool(self.pool):
            raise PolicyError("a surrogate, and nothing else, has a pool")
        if any(not p.strip() for p in self.pool) or len(set(self.pool)) != len(self.pool):
            raise PolicyError("blank or repeated surrogates")
        if not 4 <= self.fingerprint_chars <= 16:
            raise PolicyError("fingerprint_chars must be within 4 and 16")

    @property
    def realistic(self) -> bool:
        """Could be taken for real data."""
        return self.strategy in ("constant", "surrogate")


@dataclass(frozen=True)
class Entity:
    name: str
    category: str = "other"
    action: str = "MASK"
    threshold: float = 0.5
    placeholder: str | None = None
    prompt: str | None = None
    preview: Preview = Preview()
    replacement: Replacement = Replacement()

    def __post_init__(self) -> None:
        if not ENTITY_NAME.match(self.name):
            raise PolicyError(f"bad entity name {self.name!r}")
        if self.action not in ACTIONS or self.category not in CATEGORIES or not 0 <= self.threshold <= 1:
            raise PolicyError(f"bad values for {self.name}")

    @property
    def mark(self) -> str:
        return self.placeholder or f"<{self.name}>"

    @property
    def vocabulary(self) -> frozenset[str]:
        """Values that masking itself writes, so that masking twice changes nothing."""
        known = {self.mark, *self.replacement.pool}
        return frozenset(known | ({self.replacement.value} if self.replacement.value else set()))


# The entities that ship, with their category, action, threshold, placeholder, preview and prompt.
BASELINE = (
    Entity("EG_NATIONAL_ID", "id", "MASK", 0.80, preview=Preview("first_last", 4, 4)),
    Entity("EG_PASSPORT", "id", "MASK", 0.60, preview=Preview("first_last", 1, 2)),
    Entity("EG_TAX_ID", "id", "MASK", 0.60, preview=Preview("first_last", 2, 2)),
    Entity("EG_MOBILE", "contact", "MASK", 0.60, preview=Preview("first_last", 3, 2)),
    Entity("EG_IBAN", "finance", "MASK", 0.70, preview=Preview("first_last", 4, 4)),
    Entity("EMAIL_ADDRESS", "contact", "MASK", 0.50, "<EMAIL>"),
    Entity("CREDIT_CARD", "finance", "MASK", 0.60, preview=Preview("last", 0, 4)),
    Entity("IBAN_CODE", "finance", "MASK", 0.70, "<IBAN>", preview=Preview("first_last", 4, 4)),
    Entity("AR_PERSON", "person", "MASK", 0.60),
    Entity("AR_LOCATION", "location", "MASK", 0.60),
    Entity("AR_ORG", "other", "ALLOW", 0.60),
    Entity("EG_ADDRESS", "location", "MASK", 0.55),
    Entity("PERSON", "person", "MASK", 0.70, prompt="person name"),
    Entity("LOCATION", "location", "MASK", 0.70, prompt="location"),
    Entity("ORGANIZATION", "other", "ALLOW", 0.70, prompt="organization"),
)

# Arabic and English names of the 27 governorates.
GOVERNORATE_NAMES = (
    "القاهرة", "الإسكندرية", "بورسعيد", "السويس", "دمياط", "الدقهلية", "الشرقية", "القليوبية", "كفر الشيخ",
    "الغربية", "المنوفية", "البحيرة", "الإسماعيلية", "الجيزة", "بني سويف", "الفيوم", "المنيا", "أسيوط",
    "سوهاج", "قنا", "أسوان", "الأقصر", "البحر الأحمر", "الوادي الجديد", "مطروح", "شمال سيناء", "جنوب سيناء",
    "Cairo", "Alexandria", "Port Said", "Suez", "Damietta", "Dakahlia", "Sharqia", "Qalyubia", "Kafr El Sheikh",
    "Gharbia", "Monufia", "Beheira", "Ismailia", "Giza", "Beni Suef", "Fayoum", "Minya", "Asyut",
    "Sohag", "Qena", "Aswan", "Luxor", "Red Sea", "New Valley", "Matrouh", "North Sinai", "South Sinai",
)
# Words that open an address, by group; those of the area group are too common to.
MARKERS = {
    "street": ("شارع", "ش", "طريق", "كورنيش"),
    "building": ("عمارة", "برج", "مبنى", "بلوك", "عقار"),
    "unit": ("شقة", "الدور", "دور", "وحدة", "مكتب"),
    "area": ("مدينة", "حي", "منطقة", "مجاورة", "ميدان", "قرية", "مركز", "قسم", "محافظة", "تقسيم"),
    "postal": ("ص.ب", "صندوق بريد", "الرمز البريدي"),
}
MARKER_GROUPS = ("street", "building", "unit", "postal")
# Districts and new cities.
LOCALITIES = (
    "المعادي", "مدينة نصر", "مصر الجديدة", "الزمالك", "المهندسين", "الدقي", "الهرم", "فيصل", "شبرا", "حلوان",
    "العبور", "الشروق", "الرحاب", "التجمع الخامس", "الشيخ زايد", "أكتوبر", "السادس من أكتوبر", "العاشر من رمضان",
    "برج العرب", "سموحة", "المنتزه", "العجمي", "الساحل الشمالي", "الغردقة", "شرم الشيخ", "دهب", "العلمين",
)
# Terms near a value that speak for it.
CONTEXT = {
    "national_id": ("الرقم القومي", "رقم قومي", "الرقم القومى", "بطاقة", "البطاقة", "رقم البطاقة", "national id", "nid"),
    "mobile": ("موبايل", "محمول", "تليفون", "هاتف", "رقم الموبايل", "mobile", "phone"),
    "address": ("عنوان", "العنوان", "السكن", "محل الإقامة", "address"),
    "passport": ("جواز", "جواز سفر", "رقم الجواز", "passport"),
    "tax": ("بطاقة ضريبية", "الرقم الضريبي", "تسجيل ضريبي", "tax id", "tax registration"),
    "bank": ("حساب", "رقم الحساب", "الحساب البنكي", "ايبان", "iban", "account"),
    "person": ("الاسم", "اسم", "المريض", "العميل", "الموظف"),
}


def folded_terms(terms: tuple[str, ...]) -> tuple[str, ...]:
    """Terms in the form that context is searched in, sorted, so the term reported is always the same."""
    return tuple(sorted({f for t in terms if (f := fold_text(t, GAZETTEER)[0].lower())}))


@dataclass(frozen=True)
class Gazetteer:
    governorates: tuple[str, ...] = GOVERNORATE_NAMES
    markers: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(MARKERS))
    marker_groups: tuple[str, ...] = MARKER_GROUPS
    localities: tuple[str, ...] = LOCALITIES
    context: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(CONTEXT))

    @property
    def address_markers(self) -> tuple[str, ...]:
        """Longest first."""
        return tuple(sorted({m for g in self.marker_groups for m in self.markers.get(g, ())}, key=lambda m: (-len(m), m)))

    @property
    def places(self) -> tuple[str, ...]:
        return tuple(sorted((*self.governorates, *self.localities), key=lambda p: (-len(p), p)))


@dataclass(frozen=True)
class Policy:
    entities: dict[str, Entity]
    gazetteer: Gazetteer = Gazetteer()

    def __post_init__(self) -> None:
        if not self.entities:
            raise PolicyError("a policy needs entities")

    @property
    def prompts(self) -> dict[str, str]:
        """Prompt to entity, for zero-shot models."""
        return {e.prompt: e.name for e in self.entities.values() if e.prompt}

    @property
    def realistic(self) -> tuple[str, ...]:
        return tuple(sorted(n for n, e in self.entities.items() if e.replacement.realistic))

    def fingerprint(self) -> str:
        """16 hexadecimal digits that change with anything detection or masking depends on."""
        rows = sorted(f"{e.name}:{e.action}:{e.threshold!r}:{e.mark}:{e.prompt}:{e.preview}:{e.replacement}" for e in self.entities.values())
        return hashlib.sha256("\n".join(rows).encode()).hexdigest()[:16]

    def rows(self, spark: SparkSession) -> DataFrame:
        """A row per entity, for joins."""
        data = [(e.name, e.category, e.action, float(e.threshold), e.mark, e.prompt, e.replacement.strategy, e.replacement.value, list(e.replacement.pool)) for e in self.entities.values()]
        return spark.createDataFrame(data, "entity_type string, category string, action string, threshold double, placeholder string, prompt string, strategy string, constant string, pool array<string>")


def baseline() -> Policy:
    return Policy({e.name: e for e in BASELINE})


def _read(folder: Path, stem: str) -> dict:
    for suffix in (".json", ".yaml", ".yml"):
        if (path := folder / f"{stem}{suffix}").exists():
            if suffix == ".json":
                return json.loads(path.read_text("utf-8"))
            import yaml

            return yaml.safe_load(path.read_text("utf-8")) or {}
    return {}


def _known(where: str, given: dict, allowed: set[str]) -> dict:
    if extra := set(given) - allowed:
        raise PolicyError(f"unknown keys in {where}: {sorted(extra)}")
    return given


def load(folder: str) -> Policy:
    """A policy from files entities, preview_policy, replacement_policy and gazetteer in a folder; strict about unknown keys."""
    root = Path(folder)
    defined = _known("entities", _read(root, "entities"), {"version", "defaults", "entities"})
    defaults = _known("defaults", defined.get("defaults") or {}, {"action", "score_threshold", "category"})
    previews = _known("preview_policy", _read(root, "preview_policy"), {"version", "default", "rules"}).get("rules") or {}
    replacing = _known("replacement_policy", _read(root, "replacement_policy"), {"version", "default", "rules"})
    rules, default_rule = replacing.get("rules") or {}, _replacement(replacing.get("default") or {})
    names = defined.get("entities") or {}
    for what, given in (("preview", previews), ("replacement", rules)):
        if orphans := sorted(set(given) - set(names)):
            raise PolicyError(f"{what} rules without an entity: {orphans}")
    made = {}
    for name, e in names.items():
        e = _known(name, e or {}, {"category", "action", "score_threshold", "placeholder", "gliner_prompt", "prompt", "tier", "description", "recognizer"})
        pre = previews.get(name) or {}
        made[name] = Entity(
            name,
            str(e.get("category", defaults.get("category", "other"))).lower(),
            str(e.get("action", defaults.get("action", "MASK"))).upper(),
            float(e.get("score_threshold", defaults.get("score_threshold", 0.5))),
            e.get("placeholder"),
            e.get("prompt") or e.get("gliner_prompt"),
            Preview(pre.get("mode") or pre.get("strategy") or "none", int(pre.get("first", 0)), int(pre.get("last", 0))),
            _replacement(rules[name]) if name in rules else default_rule,
        )
    return Policy(made, _gazetteer(_read(root, "gazetteer") or _read(root, "gazetteer_eg")))


def _replacement(given: dict) -> Replacement:
    given = _known("replacement", given, {"strategy", "value", "pool", "fingerprint_chars", "description"})
    return Replacement(given.get("strategy", "placeholder"), given.get("value"), tuple(given.get("pool") or ()), int(given.get("fingerprint_chars", 8)))


def _gazetteer(given: dict) -> Gazetteer:
    if not given:
        return Gazetteer()
    regions = given.get("governorates") or []
    codes = [r["code"] for r in regions]
    if twice := sorted({c for c in codes if codes.count(c) > 1}):
        raise PolicyError(f"governorate codes given twice: {twice}")
    names = tuple(r["ar"] for r in regions) + tuple(r["en"] for r in regions)
    tuples = lambda d: {k: tuple(v) for k, v in (d or {}).items()}
    return Gazetteer(names, tuples(given.get("structural_markers")), tuple(given.get("address_marker_groups") or MARKER_GROUPS), tuple(given.get("localities") or ()), tuples(given.get("context_terms")))


#: Columns of the table of custom entities.
OVERLAY_SCHEMA = (
    "entity_type string, gliner_prompt string, category string, action string, score_threshold double, placeholder string, "
    "replacement_strategy string, replacement_value string, replacement_pool array<string>, enabled boolean, note string, "
    "created_at timestamp, updated_at timestamp, updated_by string"
)


def overlay(base: Policy, rows: list[dict]) -> tuple[Policy, list[str]]:
    """Custom entities over a policy, field by field: null keeps the value below; a new entity needs a prompt; disabled ones go.

    Gives the policy and the messages of rows that were skipped as invalid.
    """
    made, skipped = dict(base.entities), []
    for row in sorted(rows, key=lambda r: r["entity_type"]):
        name = row["entity_type"]
        if row.get("enabled") is False:
            made.pop(name, None)
            continue
        try:
            below = made.get(name)
            if below is None and not row.get("gliner_prompt"):
                raise PolicyError(f"{name} is new and needs a prompt")
            below = below or Entity(name)
            rule = below.replacement
            if row.get("replacement_strategy"):
                rule = Replacement(row["replacement_strategy"], row.get("replacement_value"), tuple(row.get("replacement_pool") or ()))
            given = {"category": (row.get("category") or "").lower() or None, "action": (row.get("action") or "").upper() or None, "threshold": row.get("score_threshold"), "placeholder": row.get("placeholder"), "prompt": row.get("gliner_prompt")}
            made[name] = replace(below, replacement=rule, **{k: v for k, v in given.items() if v is not None})
        except PolicyError as e:
            skipped.append(str(e))
    return Policy(made, base.gazetteer), skipped


def upsert_overlay(table: DataFrame, new: DataFrame, base: Policy) -> DataFrame:
    """The table of custom entities with ``new`` rows in the place of those of the same entity; when a row was made stays.

    Raises if a new row could not become an entity, as it would be skipped
    at every later load. The new rows are few by nature.
    """
    rows = [r.asDict() for r in new.collect()]
    if bad := overlay(base, rows)[1]:
        raise PolicyError("; ".join(bad))
    names = [x.split()[0] for x in OVERLAY_SCHEMA.split(", ")]
    old = table.select(F.col("entity_type").alias("__name"), F.col("created_at").alias("__made"))
    fresh = new.join(old, F.col("entity_type") == F.col("__name"), "left").withColumn("created_at", F.coalesce("__made", "created_at")).select(*names)
    return table.join(new.select("entity_type"), "entity_type", "left_anti").select(*names).unionByName(fresh)


def delete_overlay(table: DataFrame, name: str) -> DataFrame:
    """The table without a custom entity, which goes back to the policy below; raises if it has no row."""
    if table.where(F.col("entity_type") == name).isEmpty():
        raise PolicyError(f"no custom row for {name}")
    return table.where(F.col("entity_type") != name)


def strategies(spark: SparkSession) -> DataFrame:
    """What can stand for a masked value: name, example, whether it could be taken for real data, and what it is good for."""
    rows = [
        ("placeholder", "<PERSON>", "the entity's name in brackets; nobody takes it for data"),
        ("constant", "John Doe", "one text for all values; different values can no longer be told apart"),
        ("surrogate", "John Doe, Jane Roe", "a text from a pool, by the value's fingerprint: equal values stay equal"),
        ("redact", "", "nothing; the span goes"),
        ("labelled_fingerprint", "<PERSON:9f75871d>", "the name and some digits of the fingerprint, which an auditor can look up"),
    ]
    return spark.createDataFrame([(n, e, n in ("constant", "surrogate"), d) for n, e, d in rows], "name string, example string, realistic boolean, description string")


def overlay_table(base: Policy, table: DataFrame) -> tuple[Policy, list[str]]:
    """``overlay`` with the rows of a table; a policy has tens of entities, so the table is small by nature."""
    return overlay(base, [r.asDict() for r in table.orderBy("entity_type").collect()])
