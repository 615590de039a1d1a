"""DataFrame operators: cleaning, tokens, terms, ratings, matching, comparisons."""
