"""Writers: releases of several tables at once, documents by owner."""
