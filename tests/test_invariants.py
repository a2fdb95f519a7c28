"""Each rule of detection and preparation results has a row that breaks it alone."""

from vozlake.plans import routing_queries as rq


def test_detection(spark):
    rows = {
        "": ("detected", True, True, "es", "Español", 0.5, None), "unsupported_status": ("odd", False, False, None, None, None, "x"),
        "confidence_out_of_range": ("detected", True, True, "es", "Español", 1.5, None), "success_against_status": ("error", True, False, None, None, None, None),
        "detected_without_supported_language": ("detected", True, True, "es", "Inglés", 0.5, None),
        "supported_without_detection": ("unsupported", True, True, "de", None, 0.5, None), "success_with_error": ("unsupported", True, False, "de", None, 0.5, "x"),
        "failure_without_error": ("error", False, False, None, None, None, "")}
    data = spark.createDataFrame([(k, *v) for k, v in rows.items()], "k string, status string, success boolean, supported boolean, detected_language string, language_name string, confidence double, error_code string")
    got = {r.k: r.v for r in data.select("k", rq.detection_violations().alias("v")).collect()}
    assert got == {k: [k] if k else [] for k in rows}


def test_preparation(spark):
    rows = {
        "": ("translated", True, "o", "t", "t"), "unsupported_state": ("odd", False, "o", None, "o"), "empty_analysis_text": ("not_needed", False, "o", None, ""),
        "translated_without_request_or_text": ("translated", False, "o", "t", "t"), "translation_not_analysed": ("translated", True, "o", "t", "o"),
        "text_without_translated_state": ("not_needed", False, "o", "t", "o"), "fallback_changed_text": ("fallback_original", True, "o", None, "t")}
    data = spark.createDataFrame([(k, *v) for k, v in rows.items()], "k string, translation_state string, translation_requested boolean, original_text string, translated_text string, analysis_text string")
    got = {r.k: r.v for r in data.select("k", rq.preparation_violations().alias("v")).collect()}
    assert got == {k: [k] if k else [] for k in rows}
