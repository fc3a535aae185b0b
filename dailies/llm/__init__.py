"""Training-data operators: decontamination, chat windows, licence and secret scans, sharding, de-duplication, tokens, language."""
