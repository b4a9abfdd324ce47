"""The registered queries: ``queries`` holds the dictionaries, ``planted`` adds to them."""

from sitara.plans import planted, queries  # noqa: F401
