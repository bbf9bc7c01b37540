"""PySpark jobs that curate text, question banks, label data and training corpora."""
