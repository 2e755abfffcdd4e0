"""Rules over whole documents: class, race and spell files, overrides, encodings."""
