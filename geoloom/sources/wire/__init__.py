"""The wire format of map files: varints, blobs, blocks."""
