"""keyloom: multimodal retrieval, ranking and audit operators on PySpark."""
