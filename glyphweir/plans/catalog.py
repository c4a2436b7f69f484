"""All queries outside the llm subpackage."""

from __future__ import annotations

from glyphweir.plans import audits, corpus, decoding, extras, quality, sessions, streams
from glyphweir.plans.corpus_sql import SQL as CORPUS_SQL
from glyphweir.plans.folds_sql import SQL as FOLDS_SQL
from glyphweir.plans.sessions_sql import SQL as SESSIONS_SQL

QUERIES = {**decoding.QUERIES, **corpus.QUERIES, **sessions.QUERIES, **extras.QUERIES, **streams.QUERIES, **quality.QUERIES, **audits.QUERIES}
SQL = {**decoding.SQL, **CORPUS_SQL, **SESSIONS_SQL, **extras.SQL, **streams.SQL, **quality.SQL, **audits.SQL, **FOLDS_SQL}
flagship = decoding.decode_word_topk
