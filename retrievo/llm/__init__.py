"""Training-data operators: joins, classifiers, decontamination, scoring, extraction, tokens, filters, archives."""
