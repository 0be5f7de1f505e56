"""Corpus operators for preparing training data; nothing else imports them."""
