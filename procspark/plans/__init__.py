"""Named queries over the test tables and their SQL twins."""

from __future__ import annotations

from procspark.plans import answers, answers_sql, process, process_sql, texts, texts_sql, vectors, vectors_sql

QUERIES = {**process.QUERIES, **texts.QUERIES, **answers.QUERIES, **vectors.QUERIES}
SQL = {**process_sql.SQL, **texts_sql.SQL, **answers_sql.SQL, **vectors_sql.SQL}
