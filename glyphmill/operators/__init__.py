"""DataFrame operators: tokens, dictionary, codec, curation, evaluation, markup."""
