"""Archives and directories in, files out."""
