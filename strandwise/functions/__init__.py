"""Row-level functions as Column builders."""
