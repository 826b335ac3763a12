"""quillstone: a Spark-first engine for exact, sourced and explainable questions."""
