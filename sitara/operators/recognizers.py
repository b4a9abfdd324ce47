"""Pattern recognizers over DIGITS-folded text: what they look for and how a match is judged.

``scan`` turns them into one native expression; a guard keeps rows without
candidates off the costly part.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitara.functions import validators as v
from sitara.functions.text import fold, let
from sitara.sources.policy import Policy, folded_terms

CONTEXT_WINDOW = 64
CONTEXT_BOOST = 0.35
#: Added for a known place in an address.
PLACE_BOOST = 0.2

Check = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Recognizer:
    """One pattern of an entity.

    ``score`` is the pattern's own; ``judge`` gives a value's score, null to
    drop it; ``terms`` near a match add CONTEXT_BOOST. A text without ``sign``
    is passed over, or without two digits side by side if ``digits``.
    """

    entity: str
    name: str
    pattern: str
    score: float
    judge: Callable[[Column, float], Column] | None = None
    terms: tuple[str, ...] = ()
    window: int = CONTEXT_WINDOW
    places: tuple[str, ...] = ()
    arabic_only: bool = False
    sign: str | None = None
    digits: bool = False

    def base(self, value: Column) -> Column:
        """The score of a match without its context; null if it is none."""
        return (self.judge(value, self.score) if self.judge else F.lit(self.score)).cast("double")


def context_term(text: Column, start: Column, end: Column, terms: tuple[str, ...], window: int = CONTEXT_WINDOW) -> Column:
    """The first of the sorted, folded terms within ``window`` characters before or after a span; null if none."""
    lo = F.greatest(start - window, F.lit(0))
    around = F.concat(fold(F.substring(text, lo + 1, start - lo)), F.lit(" \x00 "), fold(F.substring(text, end + 1, F.lit(window))))
    return let(around, lambda a: F.coalesce(*[F.when(F.contains(a, F.lit(t)), F.lit(t)) for t in terms], F.lit(None).cast("string")))


def _keep_if(check: Callable[[Column], Column]) -> Callable[[Column, float], Column]:
    return lambda value, score: F.when(check(value), F.lit(score))


def _quote(term: str) -> str:
    return re.sub(r"([.\\+*?\[\]^$(){}|])", r"\\\1", term)


def _address(policy: Policy) -> str:
    markers = "|".join(map(_quote, policy.gazetteer.address_markers))
    places = "|".join(map(_quote, policy.gazetteer.places))
    return rf"(?U)(?:[0-9]{{1,4}}\s+)?\b(?:{markers})\s+[^\n،,.;]{{2,60}}(?:[،,]\s*(?:{places}))?"


#: No place inside hexadecimal text (digests, keys): there a run of digits has letters to F on both sides, or at one side a letter and two more such characters.
NOT_HEX = r"(?<![0-9A-Fa-f]{2}[A-Fa-f])(?![0-9]+[A-Fa-f][0-9A-Fa-f]{2})(?!(?<=[A-Fa-f])[0-9]+[A-Fa-f])"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\."
#: Labels are taken for good (any number of them, without deep matching) as long as another label or the last one follows.
EMAIL = rf"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]+@(?:{_LABEL}(?=[A-Za-z]{{2,}}+(?![A-Za-z0-9])|{_LABEL}))++[A-Za-z]{{2,}}(?![A-Za-z0-9])"


def recognizers(policy: Policy, today: Column | None = None) -> list[Recognizer]:
    """The recognizers of the entities that the policy declares."""
    c = {k: folded_terms(t) for k, t in policy.gazetteer.context.items()}
    nid = lambda value, _: let(v.parse_nid(value, today), lambda p: F.when(p.isNotNull(), v.nid_score(p)))
    mobile = _keep_if(lambda x: v.mobile_e164(x).isNotNull())
    found = [
        Recognizer("EG_NATIONAL_ID", "national_id", rf"(?<![0-9]){NOT_HEX}[0-9]{{14}}(?![0-9])", 0.85, nid, c.get("national_id", ()), digits=True),
        Recognizer("EG_MOBILE", "mobile_international", rf"(?<![0-9])(?:\+|{NOT_HEX}(?:00)?)20[ \-.]?1[0125][ \-.]?[0-9]{{4}}[ \-.]?[0-9]{{4}}(?![0-9])", 0.7, mobile, c.get("mobile", ()), digits=True),
        Recognizer("EG_MOBILE", "mobile_local", rf"(?<![0-9+]){NOT_HEX}01[0125][ \-.]?[0-9]{{4}}[ \-.]?[0-9]{{4}}(?![0-9])", 0.6, mobile, c.get("mobile", ()), digits=True),
        Recognizer("EG_IBAN", "eg_iban", r"(?i)(?<![A-Z0-9])EG[0-9]{2}(?:[ \-]?[A-Z0-9]){25}(?![A-Z0-9])", 0.8, _keep_if(v.eg_iban_valid), c.get("bank", ()), digits=True),
        Recognizer("EG_TAX_ID", "tax_id", r"(?<![0-9/-])[0-9]{3}[ \-/]?[0-9]{3}[ \-/]?[0-9]{3}(?![0-9/-])", 0.3, _keep_if(v.tax_id_plausible), c.get("tax", ()), digits=True),
        Recognizer("EG_PASSPORT", "passport", r"(?<![A-Za-z0-9])[A-Z][0-9]{8}(?![A-Za-z0-9])", 0.3, None, c.get("passport", ()), digits=True),
        Recognizer("EMAIL_ADDRESS", "email", EMAIL, 1.0, sign="@"),
        Recognizer("CREDIT_CARD", "card", r"(?<![0-9])(?=[1-9])(?:[0-9]{13,19}|[0-9]{4}[ \-][0-9]{4}[ \-][0-9]{4}[ \-][0-9]{1,7}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})(?![0-9])", 1.0, _keep_if(v.luhn_ok), digits=True),
        Recognizer("IBAN_CODE", "iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ \-]?[A-Z0-9]){11,30}(?![A-Za-z0-9])", 1.0, _keep_if(v.iban_valid), digits=True),
        Recognizer("EG_ADDRESS", "address", _address(policy), 0.45, None, c.get("address", ()), 48, folded_terms(policy.gazetteer.places), True),
    ]
    return [r for r in found if r.entity in policy.entities]
