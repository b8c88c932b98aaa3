"""T-01: the file-source stream scores requests exactly like the batch job (R-06)."""

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    from reelsight.plans.model_queries import q_request_stream, q_score_requests

    def key(df):
        return sorted((r.RequestID, r.model_used, None if r.PredictedScore is None else round(r.PredictedScore, 9))
                      for r in df.collect())

    batch = key(q_score_requests(spark, SF))
    stream = key(q_request_stream(spark, SF))
    assert len(batch) == 1000
    assert stream == batch
