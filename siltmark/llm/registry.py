"""Queries of this subpackage and the SQL of those that SQL can express."""

from . import chat, decontaminate, html, pii, quality, secrets, sentencepiece, sharding, simhash, sql, toxicity


def queries() -> dict:
    found: dict = {}
    for m in (sentencepiece, toxicity, pii, quality, chat, sharding, secrets, simhash, decontaminate, html):
        found |= m.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    return dict(sql.SQL)
