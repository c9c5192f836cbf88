"""Topics over a stream of documents: each micro-batch is one online update of the variational parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from loomgraph.functions import linalg
from loomgraph.operators import lda


class OnlineTopics:
    """Holds the current topics; K x p, so small whatever has streamed by. total: documents expected in all."""

    def __init__(self, vocab: DataFrame, k: int, total: float = 1e6, seed: int = 0):
        self.vocab, self.k, self.total = vocab.persist(), k, total
        self.model, self.step = lda.start(k, self.vocab.count(), seed=seed), 0

    def update(self, counts: DataFrame, _: int = 0) -> None:
        """counts: (doc_id, term, n) of one micro-batch; words outside the vocabulary are left out."""
        rows = linalg.rows(counts.withColumn("x", counts["n"].cast("double")), self.vocab)
        self.model = self.model.partial_fit(lda.with_prior(rows, self.k), self.step, self.total)
        self.step += 1

    def start(self, counts: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """counts: a streaming (doc_id, term, n), not aggregated over batches."""
        return counts.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
