"""Operators over message corpora for training data."""

import os

TOKENIZERS = os.environ.get("TIDEPATH_TOKENIZERS", "/opt/tokenizers")  # folder of public tokenizer files
