"""Derived inputs, as SQL that Spark and the checking engine both understand.

The base tables hold no external verdicts, call logs or annotation packets, so
these are computed from them: one derived row per base row, every base row used.
"""

from __future__ import annotations

# expected class of a labelled comment
TRUTH = """
SELECT doc_id, CASE WHEN toxic = 1 THEN 'Negativo' WHEN quality = 0 THEN 'Neutro' ELSE 'Positivo' END AS expected
FROM {labels}
"""

# external verdicts per comment and kind of call
RESPONSES = """
SELECT order_key, kind, raw, finish_reason, transport_error, 'reviewer' AS provider, 'remote-model' AS model,
       CAST(order_key % 900 AS DOUBLE) + 100.5 AS latency_ms,
       CASE WHEN order_key % 23 = 5 OR transport_error IS NOT NULL THEN NULL ELSE 100 + order_key % 50 END AS prompt_tokens,
       CASE WHEN order_key % 29 = 6 OR transport_error IS NOT NULL THEN NULL ELSE 10 + order_key % 20 END AS completion_tokens
FROM (
  SELECT doc_id AS order_key, 'sentiment_review' AS kind,
    CASE doc_id % 17
      WHEN 0 THEN ''
      WHEN 1 THEN 'no json here'
      WHEN 2 THEN '["Neutro"]'
      WHEN 3 THEN '{{"sentiment":"Malo"}}'
      WHEN 4 THEN '{{"sentiment":"Positivo","note":1}}'
      WHEN 5 THEN '{{"sentiment":"Neutro","confidence":true}}'
      WHEN 6 THEN '{{"sentiment":"Neutro","confidence":1.5}}'
      WHEN 7 THEN '{{"sentiment":"Negativo","rationale":3}}'
      WHEN 8 THEN '{{"sentiment":"Negativo","confidence":0.9,"rationale":"  tono claro "}}'
      WHEN 9 THEN NULL
      WHEN 10 THEN '{{"sentiment":"Positivo","confidence":null}}'
      WHEN 11 THEN '{{"sentiment":"Neutro","confidence":"alta"}}'
      ELSE concat('{{"sentiment":"', CASE doc_id % 3 WHEN 0 THEN 'Negativo' WHEN 1 THEN 'Neutro' ELSE 'Positivo' END,
                  '","confidence":0.', CAST(50 + doc_id % 50 AS STRING), '}}')
    END AS raw,
    'stop' AS finish_reason,
    CASE doc_id % 31 WHEN 3 THEN 'timeout' WHEN 4 THEN 'rate_limited' WHEN 5 THEN 'provider_error' END AS transport_error
  FROM {documents} WHERE doc_id % 19 <> 0
  UNION ALL
  SELECT doc_id AS order_key, 'direct_review' AS kind,
    CASE doc_id % 13
      WHEN 0 THEN NULL
      WHEN 1 THEN 'sentiment: Positivo'
      WHEN 2 THEN '{{"sentiment":"Positivo","confidence":1}}'
      WHEN 3 THEN '{{"sentiment":"Mixto"}}'
      WHEN 4 THEN '"Positivo"'
      ELSE concat('{{"sentiment":"', CASE doc_id % 3 WHEN 0 THEN 'Positivo' WHEN 1 THEN 'Negativo' ELSE 'Neutro' END, '"}}')
    END AS raw,
    CASE WHEN doc_id % 13 = 5 THEN 'length' ELSE 'stop' END AS finish_reason,
    CASE doc_id % 37 WHEN 7 THEN 'timeout' WHEN 8 THEN 'rate_limited' END AS transport_error
  FROM {documents} WHERE doc_id % 41 <> 0
  UNION ALL
  SELECT doc_id AS order_key, 'translation' AS kind,
    CASE doc_id % 11
      WHEN 0 THEN ' '
      WHEN 1 THEN '{{"translated_text":"falta el idioma"}}'
      WHEN 2 THEN concat('{{"source_language":"', lang, '","translated_text":"   "}}')
      WHEN 3 THEN '{{"source_language":"pt","translated_text":"servicio bueno"}}'
      WHEN 4 THEN '{{broken'
      ELSE concat('{{"source_language":"', lang, '","translated_text":" ',
                  CASE doc_id % 4 WHEN 0 THEN 'servicio terrible y muy malo, no recomiendo'
                                  WHEN 1 THEN 'excelente, muy bueno, gracias'
                                  WHEN 2 THEN 'la entrega de la factura y el horario'
                                  ELSE 'texto sin palabras del modelo' END, ' "}}')
    END AS raw,
    'stop' AS finish_reason,
    CASE doc_id % 43 WHEN 9 THEN 'timeout' END AS transport_error
  FROM {documents} WHERE doc_id % 47 <> 0
)
"""

# one row per external request; every (case, architecture) has up to three tries
REQUEST_LOG = """
SELECT event_id, ts, concat('key', CAST(user_id AS STRING)) AS provider_key,
  concat('case', CAST(CAST(floor(event_id / 6) AS BIGINT) AS STRING)) AS case_id,
  CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS architecture,
  CASE event_type WHEN 'click' THEN 'translation' WHEN 'purchase' THEN 'direct_review'
                  WHEN 'error' THEN 'direct_review' ELSE 'sentiment_review' END AS call_type,
  CASE WHEN error_code IS NULL THEN 'success' ELSE 'failed' END AS state,
  error_code IS NULL AS success, error_code,
  CASE WHEN error_code IN ('timeout', 'rate_limited') THEN NULL
       WHEN error_code = 'completion_truncated' THEN 'length' ELSE 'stop' END AS finish_reason,
  CASE WHEN error_code IN ('timeout', 'rate_limited') THEN NULL ELSE 100 + k END AS input_tokens,
  CASE WHEN error_code IN ('timeout', 'rate_limited') THEN NULL ELSE 10 + k % 20 END AS output_tokens,
  value * 10 AS latency_ms, CAST(k % 60 AS DOUBLE) / 4 AS pacing_wait_seconds,
  CASE user_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'pt' WHEN 2 THEN 'it' ELSE 'es' END AS language,
  expected AS expected_sentiment,
  CASE WHEN error_code IS NOT NULL THEN NULL
       WHEN event_id % 11 = 0 THEN CASE expected WHEN 'Neutro' THEN 'Positivo' ELSE 'Neutro' END
       ELSE expected END AS sentiment,
  CASE CAST(floor(event_id / 6) AS BIGINT) % 3 WHEN 0 THEN 'Positivo' WHEN 1 THEN 'Neutro' ELSE 'Negativo' END AS local_sentiment,
  event_id % 4 = 0 AS short_text,
  CASE event_id % 5 WHEN 0 THEN 'clear' WHEN 1 THEN 'contrast' WHEN 2 THEN 'factual_neutral'
                    WHEN 3 THEN 'negation' ELSE 'short_text' END AS difficulty,
  CASE WHEN event_id % 2 = 0 THEN 'sentiment_only' ELSE 'sentiment_rationale' END AS contract_variant
FROM (
  SELECT *, CASE WHEN event_type <> 'error' THEN NULL
                 WHEN event_id % 5 = 0 THEN 'timeout' WHEN event_id % 5 = 1 THEN 'rate_limited'
                 WHEN event_id % 5 = 2 THEN 'invalid_json' WHEN event_id % 5 = 3 THEN 'invalid_schema'
                 ELSE 'completion_truncated' END AS error_code,
    CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k,
    CASE CAST(floor(event_id / 6) AS BIGINT) % 3 WHEN 0 THEN 'Negativo' WHEN 1 THEN 'Neutro' ELSE 'Positivo' END AS expected
  FROM {events}
)
"""

# annotation packet of the first annotator
PACKET_A = """
SELECT doc_id AS row_number,
  CASE WHEN doc_id % 101 = 7 THEN '' WHEN doc_id % 97 = 9 THEN 'dup-case'
       ELSE concat('case-', CAST(doc_id AS STRING)) END AS case_id,
  text AS texto_original_anonimizado,
  CASE WHEN doc_id % 89 = 3 THEN '?' ELSE source END AS source_id,
  concat('fam-', CAST(CAST(floor(doc_id / 4) AS BIGINT) AS STRING)) AS family_id,
  CASE doc_id % 7 WHEN 0 THEN 'synthetic' WHEN 1 THEN 'public_dataset' WHEN 2 THEN 'scraped' ELSE 'authorized_feedback' END AS source_type,
  CASE WHEN doc_id % 83 = 1 THEN 'English' ELSE lang END AS language,
  CASE doc_id % 6 WHEN 0 THEN 'factual' WHEN 1 THEN 'contrast' WHEN 2 THEN 'short' WHEN 3 THEN 'unlisted' ELSE 'other' END AS sentiment_subgroup,
  CASE doc_id % 9 WHEN 0 THEN 'Negativo' WHEN 1 THEN 'Neutro' WHEN 2 THEN 'Ambiguo' WHEN 3 THEN 'No evaluable'
                  WHEN 4 THEN '' WHEN 5 THEN 'Bueno' ELSE 'Positivo' END AS annotator_label,
  CASE WHEN doc_id % 2 = 0 THEN 'falta contexto' ELSE ' ' END AS uncertainty_reason,
  '' AS annotator_notes,
  CASE WHEN doc_id % 79 = 2 THEN 'sentiment-v0' ELSE 'sentiment-v1.0.0' END AS taxonomy_version
FROM {documents}
"""

# the second annotator: some cases missing, some added, some fields and labels changed
PACKET_B = """
SELECT doc_id AS row_number,
  CASE WHEN doc_id % 53 = 5 THEN concat('extra-', CAST(doc_id AS STRING))
       ELSE concat('case-', CAST(doc_id AS STRING)) END AS case_id,
  text AS texto_original_anonimizado, source AS source_id,
  concat('fam-', CAST(CAST(floor(doc_id / 4) AS BIGINT) AS STRING)) AS family_id,
  CASE doc_id % 7 WHEN 0 THEN 'synthetic' WHEN 1 THEN 'public_dataset' ELSE 'authorized_feedback' END AS source_type,
  CASE WHEN doc_id % 61 = 4 THEN 'pt' ELSE lang END AS language,
  CASE doc_id % 6 WHEN 0 THEN 'factual' WHEN 1 THEN 'contrast' WHEN 2 THEN 'short' ELSE 'other' END AS sentiment_subgroup,
  CASE WHEN doc_id % 5 = 0 THEN 'Neutro' ELSE
    CASE doc_id % 9 WHEN 0 THEN 'Negativo' WHEN 1 THEN 'Neutro' WHEN 2 THEN 'Ambiguo' WHEN 3 THEN 'No evaluable'
                    WHEN 4 THEN '' ELSE 'Positivo' END END AS annotator_label,
  '' AS uncertainty_reason, '' AS annotator_notes, 'sentiment-v1.0.0' AS taxonomy_version
FROM {documents}
"""

# annotator A again, but clean: the pair check needs two valid packets
PACKET_A_CLEAN = """
SELECT doc_id AS row_number, concat('case-', CAST(doc_id AS STRING)) AS case_id,
  text AS texto_original_anonimizado, source AS source_id,
  concat('fam-', CAST(CAST(floor(doc_id / 4) AS BIGINT) AS STRING)) AS family_id,
  CASE doc_id % 7 WHEN 0 THEN 'synthetic' WHEN 1 THEN 'public_dataset' ELSE 'authorized_feedback' END AS source_type,
  lang AS language,
  CASE doc_id % 6 WHEN 0 THEN 'factual' WHEN 1 THEN 'contrast' WHEN 2 THEN 'short' ELSE 'other' END AS sentiment_subgroup,
  CASE doc_id % 9 WHEN 0 THEN 'Negativo' WHEN 1 THEN 'Neutro' WHEN 2 THEN 'Ambiguo' WHEN 3 THEN 'No evaluable'
                  WHEN 4 THEN '' ELSE 'Positivo' END AS annotator_label,
  '' AS uncertainty_reason, '' AS annotator_notes, 'sentiment-v1.0.0' AS taxonomy_version
FROM {documents}
"""

# annotation master
MASTER = """
SELECT doc_id AS row_number,
  CASE WHEN doc_id % 97 = 9 THEN 'dup-case' ELSE concat('case-', CAST(doc_id AS STRING)) END AS case_id,
  text AS texto_original_anonimizado, source AS source_id,
  concat('fam-', CAST(CAST(floor(doc_id / 4) AS BIGINT) AS STRING)) AS family_id,
  CASE doc_id % 7 WHEN 0 THEN 'synthetic' WHEN 1 THEN 'public_dataset' WHEN 2 THEN 'scraped' ELSE 'authorized_feedback' END AS source_type,
  lang AS language,
  CASE doc_id % 8 WHEN 0 THEN 'pending' WHEN 1 THEN 'annotated' WHEN 2 THEN 'annotated' WHEN 3 THEN 'disagreement'
                  WHEN 4 THEN 'adjudicated' WHEN 5 THEN 'excluded' WHEN 6 THEN 'adjudicated' ELSE 'lost' END AS annotation_status,
  CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'Negativo' WHEN 2 THEN 'Positivo' WHEN 3 THEN 'Ambiguo' ELSE 'No evaluable' END AS annotator_1_label,
  CASE doc_id % 3 WHEN 0 THEN 'Negativo' WHEN 1 THEN '' ELSE 'Positivo' END AS annotator_2_label,
  CASE doc_id % 10 WHEN 0 THEN 'Negativo' WHEN 1 THEN 'Ambiguo' WHEN 4 THEN 'No evaluable' ELSE '' END AS adjudicated_label,
  CASE WHEN doc_id % 2 = 0 THEN 'tono' ELSE '' END AS disagreement_reason,
  CASE WHEN doc_id % 4 = 0 THEN 'revisado' ELSE ' ' END AS adjudication_notes,
  CASE doc_id % 6 WHEN 0 THEN 'factual' WHEN 3 THEN 'unlisted' ELSE 'other' END AS sentiment_subgroup,
  CASE doc_id % 12 WHEN 0 THEN '2024-13-01T00:00:00Z' WHEN 1 THEN '2024-05-01 10:00' WHEN 2 THEN 'ayer Z'
                   ELSE concat('2024-05-', CAST(10 + doc_id % 19 AS STRING), 'T10:00:00Z') END AS created_at,
  CASE WHEN doc_id % 79 = 2 THEN 'sentiment-v0' ELSE 'sentiment-v1.0.0' END AS taxonomy_version,
  CASE doc_id % 5 WHEN 0 THEN 'unassigned' WHEN 1 THEN 'development' WHEN 2 THEN 'final' WHEN 3 THEN 'excluded' ELSE 'training_only' END AS split
FROM {documents}
"""

DERIVED = {
    "truth": TRUTH,
    "responses": RESPONSES,
    "request_log": REQUEST_LOG,
    "packet_a": PACKET_A,
    "packet_a_clean": PACKET_A_CLEAN,
    "packet_b": PACKET_B,
    "master": MASTER,
}


def duckdb_text(name: str) -> str:
    """The same derivation for the checking engine, base tables by plain name."""
    sql = DERIVED[name]
    for source in ("labels", "documents", "events"):
        sql = sql.replace("{" + source + "}", source)
    return sql.replace("{{", "{").replace("}}", "}")
