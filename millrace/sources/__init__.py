"""Sources: folders of files, evaluation sets, rate cards, settings."""
