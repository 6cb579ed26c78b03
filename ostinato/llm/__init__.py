"""Training-data operators: mixing, near duplicates, archives, media, secrets, licences, language, privacy and pieces."""
